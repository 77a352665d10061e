"""Queries over the sample tables, one or more for each operator and codec, with the SQL of their results.

Doubles that are sums are rounded on both sides, since the order of summation differs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .api import pipeline
from .sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: What fixes the order of rows of a table; lineitem has no key, so nothing that depends on order runs over it.
ORDER = {"events": "event_id", "orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "documents": "doc_id", "nation": "n_nationkey", "supplier": "s_suppkey"}


def _query(name: str, source: str, text: str | dict, sql: str | None, digits: int | None = None, drop: tuple = (), other: str | None = None) -> None:
    def run(spark, sf_dir):
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet").drop(*drop)
        p = pipeline(text)
        if other:
            table, _, more = other.partition("|")
            look = spark.read.parquet(f"{sf_dir}/{table.strip()}.parquet")
            look = pipeline(more).apply(look).df if more else look
            step = next(s for s in p.plan.steps if s.op in ("join", "stack"))
            step.args |= {"file": look, "tag_value": table.strip()}
        out = p.apply(df, order=ORDER.get(source)).df
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if not c.startswith("__")])
        if digits is not None:
            out = out.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c, t in out.dtypes if t == "double"})
        return out

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_V = "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)"
_NULLS = "derive v=if(mod(event_id,3)==0,nothing,value) | select event_id,v"
_E = "ORDER BY event_id"

# projection, filters, columns
_query("flagship", "lineitem", 'filter "l_quantity > 25" | derive rev=l_extendedprice*(1-l_discount) | group-agg l_returnflag rev:sum:revenue l_quantity:avg:avg_qty | sort l_returnflag', "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_quantity), 4) AS avg_qty FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag", 4)
_query("filter", "lineitem", 'filter "l_quantity > 25 and l_discount < 0.05" | select l_orderkey,l_linenumber,l_quantity', "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
_query("grep", "part", "grep ar p_name | select p_partkey,p_name", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ar')")
_query("grep_regex_inverted", "part", "grep -rv ^[a-m].*e p_name | select p_partkey,p_name", "SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^[a-m].*e')")
_query("validate", "orders", 'validate "o_totalprice >= 1000 and not o_orderstatus == \'F\'" | select o_orderkey,_valid', "SELECT o_orderkey, (o_totalprice >= 1000 AND o_orderstatus <> 'F') AS _valid FROM orders")
_query("select", "part", "select p_size,p_partkey", "SELECT p_size, p_partkey FROM part")
_query("reorder", "part", "reorder p_brand,p_partkey", "SELECT p_brand, p_partkey FROM part")
_query("rename", "region", "rename r_name=name,r_regionkey=key", "SELECT r_regionkey AS key, r_name AS name FROM region")
_query("derive", "lineitem", "derive net=l_extendedprice*(1-l_discount) per=l_extendedprice/l_quantity k=l_orderkey+l_linenumber | select l_orderkey,net,per,k", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice / l_quantity, 6) AS per, l_orderkey + l_linenumber AS k FROM lineitem", 6)
_query("cast", "part", "cast p_size=float p_partkey=string p_retailprice=int | select p_size,p_partkey,p_retailprice", "SELECT p_size::DOUBLE AS p_size, p_partkey::VARCHAR AS p_partkey, trunc(p_retailprice)::BIGINT AS p_retailprice FROM part")
_query("trim", "part", "derive s=concat('  ',p_brand,' ') | trim s | select p_partkey,s", "SELECT p_partkey, trim('  ' || p_brand || ' ') AS s FROM part")
_query("fill_null", "events", f"{_NULLS} | fill-null v=-1", f"SELECT event_id, coalesce(v, -1.0) AS v FROM {_V}")
_query("clip", "part", "clip p_size min=10 max=40 | select p_partkey,p_size", "SELECT p_partkey, greatest(10, least(40, p_size))::BIGINT AS p_size FROM part")
_query("replace", "part", "replace p_name a _ | select p_partkey,p_name", "SELECT p_partkey, replace(p_name, 'a', '_') AS p_name FROM part")
_query("replace_regex", "part", "replace --regex p_name [aeiou]+ <&> | select p_partkey,p_name", r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '<\0>', 'g') AS p_name FROM part")
_query("hash", "nation", "hash n_nationkey,n_name", "SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(n_nationkey::VARCHAR || n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: xor((h * 33) & 4294967295, b)) AS _hash FROM nation")
_query("bin", "part", "bin p_size 10,25,40 | select p_partkey,p_size_bin", "SELECT p_partkey, CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 25 THEN '10-25' WHEN p_size < 40 THEN '25-40' ELSE '40+' END AS p_size_bin FROM part")
_query("split", "part", 'split p_name " " first,second,third | select p_partkey,first,second,third', "SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS first, nullif(split_part(p_name, ' ', 2), '') AS second, nullif(split_part(p_name, ' ', 3), '') AS third FROM part")
_query("datetime", "orders", "datetime o_orderdate | select o_orderkey,o_orderdate_year,o_orderdate_month,o_orderdate_day,o_orderdate_hour,o_orderdate_minute,o_orderdate_second,o_orderdate_weekday,o_orderdate_epoch", "SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day, hour(o_orderdate) AS o_orderdate_hour, minute(o_orderdate) AS o_orderdate_minute, second(o_orderdate) AS o_orderdate_second, dayofweek(o_orderdate) AS o_orderdate_weekday, floor(epoch(o_orderdate))::BIGINT AS o_orderdate_epoch FROM orders")
_query("date_trunc", "orders", "date-trunc o_orderdate month | datetime o_orderdate epoch | select o_orderkey,o_orderdate_epoch", "SELECT o_orderkey, epoch(date_trunc('month', o_orderdate))::BIGINT AS o_orderdate_epoch FROM orders")
_query("flatten", "region", "flatten", "SELECT * FROM region")

_query("trim_white_space", "part", "derive s=concat('\t ',p_brand,' \n') | trim s | select p_partkey,s", "SELECT p_partkey, p_brand AS s FROM part")
_query("cast_text", "events", "derive a=concat(event_id,'x') b=concat(value,' m') c=if(mod(event_id,2)==0,'false','yes') | cast a=int b=float c=bool | derive d=round(b*1000) | select event_id,a,c,d", "SELECT event_id, event_id AS a, event_id % 2 <> 0 AS c, round(printf('%.6g', value)::DOUBLE * 1000)::BIGINT AS d FROM events")
_query("cast_dates", "orders", "derive day=o_orderdate text=o_orderdate n=o_orderdate | cast day=date text=string n=int | derive t=text back=n again=text | cast t=timestamp back=timestamp again=date | derive x=t==o_orderdate y=back==o_orderdate z=again==day | select o_orderkey,text,n,x,y,z", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS text, epoch_us(o_orderdate) AS n, true AS x, true AS y, true AS z FROM orders")
_query("cast_numbers", "part", "derive a=p_size b=p_size>25 c=p_retailprice d='2020-02-30' | cast a=bool b=int c=string d=date | select p_partkey,a,b,c,d", "SELECT p_partkey, p_size <> 0 AS a, (p_size > 25)::BIGINT AS b, CASE WHEN p_retailprice = trunc(p_retailprice) OR p_retailprice >= 1000 THEN regexp_replace(regexp_replace(printf('%.6g', p_retailprice), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') ELSE printf('%.6g', p_retailprice) END AS c, NULL::DATE AS d FROM part")
_query("date_trunc_levels", "orders", "derive y=o_orderdate d=o_orderdate h=o_orderdate | date-trunc y year | date-trunc d day | date-trunc h hour | cast y=int d=int h=int | select o_orderkey,y,d,h", "SELECT o_orderkey, epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP) AS y, epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) AS d, epoch_us(date_trunc('hour', o_orderdate)::TIMESTAMP) AS h FROM orders")
_query("hash_all_kinds", "events", "derive f=value k=mod(event_id,2)==0 n=if(mod(event_id,3)==0,nothing,event_id) | hash k,n,event_type | select event_id,_hash", "SELECT event_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(CASE WHEN event_id % 2 = 0 THEN 'T' ELSE 'F' END || coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR END, '') || event_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: xor((h * 33) & 4294967295, b)) AS _hash FROM events")

# expressions
_query("expr_more", "part", "derive a=lower(p_brand) b=trim(concat(' ',p_name,' ')) c=pad_right(p_size,4,'*') d=ends_with(p_name,'e') e=exp(p_size/50) f=-p_size g=-p_retailprice h=upper('äé') | select p_partkey,a,b,c,d,e,f,g,h", "SELECT p_partkey, lower(p_brand) AS a, trim(p_name) AS b, rpad(p_size::VARCHAR, greatest(4, length(p_size::VARCHAR))::INT, '*') AS c, ends_with(p_name, 'e') AS d, round(exp(p_size / 50.0), 9) AS e, -p_size::BIGINT AS f, round(-p_retailprice, 9) AS g, 'äé' AS h FROM part", 9)
_query("expr_timestamps", "orders", "derive k=o_orderdate+3600000000 | derive d=k-o_orderdate late=k>'1995-06-17' m=k-o_orderdate==3600000000 | select o_orderkey,d,late,m", "SELECT o_orderkey, 3600000000::BIGINT AS d, o_orderdate + INTERVAL 1 HOUR > TIMESTAMP '1995-06-17' AS late, true AS m FROM orders")
_query("expr_text", "part", "derive u=upper(p_name) i=initcap(p_name) l=left(p_name,3) r=right(p_name,3) s=slice(p_name,1,4) n=len(p_name) p=pad_left(p_partkey,8,'0') c=concat(p_brand,'/',p_size) x=starts_with(p_name,'a') y=contains(p_name,'e') z=replace(p_name,'e','') | select p_partkey,u,l,r,s,n,p,c,x,y,z",
       "SELECT p_partkey, upper(p_name) AS u, left(p_name, 3) AS l, right(p_name, 3) AS r, substring(p_name, 2, 4) AS s, strlen(p_name) AS n, lpad(p_partkey::VARCHAR, greatest(8, length(p_partkey::VARCHAR))::INT, '0') AS p, p_brand || '/' || p_size AS c, starts_with(p_name, 'a') AS x, contains(p_name, 'e') AS y, replace(p_name, 'e', '') AS z FROM part")
_query("expr_number", "part", "derive a=abs(p_size-25) r=round(p_retailprice) f=floor(p_retailprice) c=ceil(p_retailprice) g=sign(p_size-25) lo=least(p_size,25) hi=greatest(p_size,25) w=pow(p_size,2) q=sqrt(p_size) l=log(p_size) m=mod(p_partkey,7) n=nullif(p_size,1) o=coalesce(nothing,p_size) t=if(p_size>25,'big','small') | select p_partkey,a,r,f,c,g,lo,hi,w,q,l,m,n,o,t",
       "SELECT p_partkey, abs(p_size - 25)::BIGINT AS a, round(p_retailprice)::BIGINT AS r, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, sign(p_size - 25)::BIGINT AS g, least(p_size, 25)::BIGINT AS lo, greatest(p_size, 25)::BIGINT AS hi, round(pow(p_size, 2), 9) AS w, round(sqrt(p_size), 9) AS q, round(ln(p_size), 9) AS l, (p_partkey % 7)::BIGINT AS m, nullif(p_size, 1)::BIGINT AS n, p_size::BIGINT AS o, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS t FROM part", 9)
_query("expr_logic", "events", f'{_NULLS} | derive a=v==nothing b=v!=nothing c=v>50 d=(not(v>50))', f"SELECT event_id, v, v IS NULL AS a, v IS NOT NULL AS b, coalesce(v > 50, false) AS c, NOT coalesce(v > 50, false) AS d FROM {_V}")
_query("expr_dates", "orders", "cast o_orderdate=date | derive k=o_orderdate+30 | derive d=k-o_orderdate late=k>'1995-06-17' | select o_orderkey,d,late", "SELECT o_orderkey, 30::BIGINT AS d, o_orderdate::DATE + 30 > DATE '1995-06-17' AS late FROM orders")

# limits, order, samples
_query("head", "orders", "head 20 | select o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20")
_query("skip", "orders", "skip 100 | select o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey OFFSET 100")
_query("tail", "orders", "tail 20 | select o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
_query("top", "orders", "top 25 o_totalprice | select o_orderkey,o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_query("top_ascending", "events", f"{_NULLS} | top 30 +v", f"SELECT * FROM {_V} ORDER BY coalesce(v, -1e308), event_id LIMIT 30")
_query("sort", "orders", "select o_orderkey,o_orderpriority,o_totalprice | sort o_orderpriority,-o_totalprice", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY 2, 3 DESC")
_query("sort_head", "orders", "select o_orderkey,o_orderpriority,o_totalprice | sort o_orderpriority,-o_totalprice | head 50", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY 2, 3 DESC, 1 LIMIT 50")
_LCG = "{} * 6364136223846793005::UHUGEINT + 1442695040888963407::UHUGEINT"
_query("split_data", "events", "split-data 0.8 | select event_id,_split",
       f"WITH a AS (SELECT event_id, xor(({_LCG.format('(row_number() OVER (ORDER BY event_id) - 1)::UHUGEINT')}) % 18446744073709551616::UHUGEINT, 42::UHUGEINT) AS x FROM events), b AS (SELECT event_id, ({_LCG.format('x')}) % 18446744073709551616::UHUGEINT AS x FROM a), c AS (SELECT event_id, ({_LCG.format('x')}) % 18446744073709551616::UHUGEINT AS x FROM b) SELECT event_id, CASE WHEN (x // 8589934592::UHUGEINT)::DOUBLE / 2147483648.0 < 0.8 THEN 'train' ELSE 'test' END AS _split FROM c")

_ROLL = f"WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT *, xor(({_LCG.format('i::UHUGEINT')}) % 18446744073709551616::UHUGEINT, 7::UHUGEINT) AS x FROM a), c AS (SELECT o_orderkey, i, ({_LCG.format('x')}) % 18446744073709551616::UHUGEINT AS x FROM b), d AS (SELECT o_orderkey, i, ({_LCG.format('x')}) % 18446744073709551616::UHUGEINT AS x FROM c)"
_query("sample", "orders", "sample 100 seed=7 | select o_orderkey", f"{_ROLL} SELECT o_orderkey FROM d ORDER BY x // 8589934592::UHUGEINT, i LIMIT 100")

# first rows, unions, joins
_query("unique", "documents", "select doc_id,text,lang | unique text | derive n=len(text) | select doc_id,lang,n", "SELECT doc_id, lang, strlen(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
_query("dedup", "lineitem", "select l_returnflag,l_linestatus | dedup", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_query("stack", "nation", "select n_nationkey,n_name | stack region --tag src", "SELECT 'input' AS src, n_nationkey, n_name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region", other="region")
_query("join_inner", "orders", "join customer on o_custkey=c_custkey | select o_orderkey,c_name,c_mktsegment", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", other="customer | select c_custkey,c_name,c_mktsegment")
_query("join_left", "nation", "join region on n_regionkey=r_regionkey --left | select n_name,r_name", "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey", other="region | filter r_regionkey>1")

for _f, _x in {"right": "RIGHT JOIN", "full": "FULL JOIN"}.items():
    _query(f"join_{_f}", "customer", f"select c_custkey,c_nationkey | filter c_nationkey<20 | join supplier on c_nationkey=s_nationkey --{_f} | select c_custkey,c_nationkey,s_suppkey", f"SELECT c_custkey, coalesce(c_nationkey, s_nationkey)::BIGINT AS c_nationkey, s_suppkey FROM (SELECT * FROM customer WHERE c_nationkey < 20) {_x} (SELECT * FROM supplier WHERE s_nationkey > 5) ON c_nationkey = s_nationkey", other="supplier | filter s_nationkey>5 | select s_suppkey,s_nationkey")
for _f, _x in {"semi": "", "anti": "NOT "}.items():
    _query(f"join_{_f}", "nation", f"join supplier on n_nationkey=s_nationkey --{_f}", f"SELECT * FROM nation WHERE {_x}EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)", other="supplier | filter s_acctbal>5000")
_query("join_two_keys_with_nulls", "events", "derive a=if(mod(event_id,2)==0,nothing,event_type) b=mod(event_id,5) | select event_id,a,b | join events on a=a,b=b | group-agg b event_id:count:n", "WITH l AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS a, event_id % 5 AS b FROM events), r AS (SELECT DISTINCT a, b FROM l WHERE b < 4) SELECT l.b, count(*)::DOUBLE AS n FROM l JOIN r ON l.a IS NOT DISTINCT FROM r.a AND l.b = r.b GROUP BY l.b", other="events | derive a=if(mod(event_id,2)==0,nothing,event_type) b=mod(event_id,5) | filter b<4 | select a,b | dedup")

# aggregates
_query("group_agg_more", "lineitem", "group-agg l_returnflag l_quantity:var:v l_quantity:stddev:s l_quantity:median:m", "SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(stddev_samp(l_quantity), 4) AS s, round(median(l_quantity), 4) AS m FROM lineitem GROUP BY 1", 4)
_query("group_agg", "lineitem", "group-agg l_returnflag l_linestatus l_quantity:sum:s l_quantity:avg:a l_quantity:count:n l_extendedprice:min:lo l_extendedprice:max:hi", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, count(*)::DOUBLE AS n, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi FROM lineitem GROUP BY 1, 2", 4)
_query("frequency", "lineitem", "frequency l_returnflag", "SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1")
_query("frequency_columns", "orders", "frequency o_orderstatus,o_orderpriority", "SELECT o_orderstatus || chr(1) || o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")


def _measures(c: str) -> str:
    m1, m2 = f"avg({c})", f"var_pop({c})"
    third = f"(avg({c}::DOUBLE * {c} * {c}) - 3 * {m1} * avg({c}::DOUBLE * {c}) + 2 * pow({m1}, 3))"
    return f"SELECT '{c}' AS column, count({c}) AS count, round(sum({c}::DOUBLE), 4) AS sum, round({m1}, 4) AS avg, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(var_samp({c}), 4) AS var, round(stddev_samp({c}), 4) AS stddev, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round({third} / pow({m2}, 1.5), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis FROM lineitem"


_query("stats", "lineitem", "select l_quantity,l_linenumber | stats count,sum,avg,min,max,var,stddev,median,p25,p75,skewness,kurtosis", " UNION ALL ".join(_measures(c) for c in ("l_quantity", "l_linenumber")), 4)
_query("stats_quantiles_by_ranges", "lineitem", {"steps": [{"op": "select", "args": {"columns": ["l_extendedprice"]}}, {"op": "stats", "args": {"stats": ["median", "p25", "p75"], "quantile_bytes": 0}}]}, "SELECT 'l_extendedprice' AS column, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 4) AS {n}" for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))) + " FROM lineitem", 4)
_query("stats_histogram", "part", "select p_size | stats count,hist", "WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi, count(*) AS n FROM part), h AS (SELECT k, count(p_size) AS c FROM range(32) r(k) CROSS JOIN b LEFT JOIN part ON least(floor((p_size - lo) / ((hi - lo) / 32.0)), 31) = k GROUP BY k) SELECT 'p_size' AS column, n AS count, lo || ':' || hi || ':' || (SELECT string_agg(c, ',' ORDER BY k) FROM h) AS hist FROM b")
_query("stats_distinct", "part", "select p_brand,p_size | stats count,distinct --exact", "SELECT 'p_brand' AS column, count(p_brand) AS count, count(DISTINCT p_brand) AS \"distinct\" FROM part UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size) FROM part")
_query("stats_sample", "part", "select p_name,p_size | stats sample", " UNION ALL ".join(f"SELECT '{c}' AS column, (SELECT string_agg(t, ',' ORDER BY h) FROM (SELECT t, md5(t) AS h FROM (SELECT DISTINCT {c}::VARCHAR AS t FROM part WHERE {c} IS NOT NULL) ORDER BY h LIMIT 10)) AS sample" for c in ("p_name", "p_size")))

# along the order of rows
for _f, _x in {"running-sum": "sum(v)", "running-min": "min(v)", "running-max": "max(v)", "running-count": "count(v)"}.items():
    _query("step_" + _f.replace("-", "_"), "events", f"{_NULLS} | step v {_f} s", f"SELECT event_id, v, CASE WHEN v IS NOT NULL THEN round(({_x} OVER ({_E}))::DOUBLE, 4) END AS s FROM {_V}", 4)
# whole numbers: their sums, and so their means, are the same doubles in any order
_query("step_running_avg", "events", "derive v=if(mod(event_id,3)==0,nothing,floor(value)) | select event_id,v | step v running-avg s", f"SELECT event_id, floor(v)::BIGINT AS v, CASE WHEN v IS NOT NULL THEN (sum(floor(v)::BIGINT) OVER ({_E}))::DOUBLE / count(v) OVER ({_E}) END AS s FROM {_V}")
_LAST = f"last_value(v IGNORE NULLS) OVER ({_E} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
for _f, _x in {"delta": "v - p", "lag": "p", "ratio": "v / nullif(p, 0)"}.items():
    _query("step_" + _f, "events", f"{_NULLS} | step v {_f} s", f"SELECT event_id, round(v, 4) AS v, CASE WHEN v IS NOT NULL THEN round({_x}, 4) END AS s FROM (SELECT *, {_LAST} AS p FROM {_V})", 4)
for _f in ("avg", "sum", "min", "max", "count"):
    _query("window_" + _f, "events", f"{_NULLS} | window v 5 {_f} s", f"SELECT event_id, round(v, 4) AS v, round({_f}(v) OVER ({_E} ROWS 4 PRECEDING)::DOUBLE, 4) AS s FROM {_V} WHERE v IS NOT NULL UNION ALL SELECT event_id, v, NULL FROM {_V} WHERE v IS NULL", 4)
_query("lead", "events", f"{_NULLS} | lead v 2", f"SELECT event_id, v, lead(v, 2) OVER ({_E}) AS v_lead FROM {_V}")
_query("fill_down", "events", f"{_NULLS} | fill-down v", f"SELECT event_id, last_value(v IGNORE NULLS) OVER ({_E}) AS v FROM {_V}")
_query("diff", "events", f"{_NULLS} | diff v", f"SELECT event_id, round(v, 4) AS v, CASE WHEN v IS NOT NULL THEN round(v - p, 4) END AS v_diff FROM (SELECT *, {_LAST} AS p FROM {_V})", 4)
_query("diff_second", "events", "diff value 2 d | select event_id,d", f"SELECT event_id, round(value - 2 * lag(value) OVER ({_E}) + lag(value, 2) OVER ({_E}), 4) AS d FROM events", 4)
_query("anomaly", "events", f"{_NULLS} | anomaly v 2", f"SELECT event_id, v, CASE WHEN abs(v - avg(v) OVER w) > 2 * stddev_samp(v) OVER w THEN 1 ELSE 0 END::BIGINT AS v_anomaly FROM {_V} WINDOW w AS ({_E})")
_query("ewma", "events", f"{_NULLS} | ewma v 0.3", f"WITH RECURSIVE o AS (SELECT *, row_number() OVER ({_E}) AS n FROM {_V} WHERE v IS NOT NULL), r AS (SELECT event_id, v, n, v AS e FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.v, o.n, 0.3 * o.v + 0.7 * r.e FROM r JOIN o ON o.n = r.n + 1) SELECT event_id, round(v, 4) AS v, round(e, 4) AS v_ewma FROM r UNION ALL SELECT event_id, NULL, NULL FROM {_V} WHERE v IS NULL", 4)
_NEAR = f"(SELECT *, row_number() OVER ({_E}) AS n, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER ({_E}) AS a, last_value(v IGNORE NULLS) OVER ({_E}) AS pv, last_value(v IGNORE NULLS) OVER (ORDER BY event_id DESC) AS nv, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id DESC) AS b FROM {_V})"
_query("interpolate_linear", "events", f"{_NULLS} | interpolate v linear", f"SELECT m.event_id, round(CASE WHEN m.v IS NOT NULL THEN m.v WHEN m.pv IS NULL THEN m.nv WHEN m.nv IS NULL THEN m.pv ELSE m.pv + (m.n - x.n)::DOUBLE / (y.n - x.n) * (m.nv - m.pv) END, 4) AS v FROM {_NEAR} m LEFT JOIN {_NEAR} x ON x.event_id = m.a LEFT JOIN {_NEAR} y ON y.event_id = m.b", 4)
_query("interpolate_forward", "events", f"{_NULLS} | interpolate v forward", f"SELECT event_id, pv AS v FROM {_NEAR}")
_query("interpolate_backward", "events", f"{_NULLS} | interpolate v backward", f"SELECT event_id, coalesce(nv, pv) AS v FROM {_NEAR}")
_query("normalize_minmax", "part", "select p_partkey,p_retailprice | normalize p_retailprice minmax", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS p_retailprice FROM part", 9)
_query("normalize_zscore", "part", "select p_partkey,p_retailprice | normalize p_retailprice zscore", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 7) AS p_retailprice FROM part", 7)
_query("acf", "events", "acf value 3", f"WITH e AS (SELECT event_id, value - avg(value) OVER () AS d FROM events), l AS (SELECT d, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM e WINDOW w AS ({_E})), s AS (SELECT sum(d * d) AS v, sum(d * d1) AS s1, sum(d * d2) AS s2, sum(d * d3) AS s3 FROM l) SELECT 0::BIGINT AS lag, 1.0::DOUBLE AS acf UNION ALL SELECT 1, round(s1 / v, 7) FROM s UNION ALL SELECT 2, round(s2 / v, 7) FROM s UNION ALL SELECT 3, round(s3 / v, 7) FROM s", 7)
_query("label_encode", "events", "label-encode event_type | select event_id,event_type_encoded", "SELECT event_id, c AS event_type_encoded FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS c FROM events GROUP BY 1) USING (event_type)")
_query("onehot", "orders", "select o_orderkey,o_orderstatus | onehot o_orderstatus --drop", "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::BIGINT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::BIGINT AS \"o_orderstatus_P\" FROM orders")

# reshaping
_query("explode", "part", 'select p_partkey,p_name | explode p_name " "', "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
_query("unpivot", "part", "select p_partkey,p_brand,p_type | unpivot p_brand,p_type", "SELECT p_partkey, 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
for _f in ("first", "sum", "count", "avg", "min", "max"):
    _c = {"first": "arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = '{s}')", "count": "nullif(count(*) FILTER (o_orderstatus = '{s}'), 0)"}.get(_f, _f + "(o_totalprice) FILTER (o_orderstatus = '{s}')")
    _cols = ", ".join((_c.format(s=s) if _f == "count" else f"round({_c.format(s=s)}, 4)") + f' AS "{s}"' for s in "FOP")
    _query(f"pivot_{_f}", "orders", f"select o_custkey,o_orderstatus,o_totalprice | pivot o_orderstatus o_totalprice {_f}", f"SELECT o_custkey, {_cols} FROM orders GROUP BY o_custkey", 4)


# files: written to the shared folder, then read back
def _file_query(name: str, source: str, columns: str, way: str, text: str, sql: str, args: dict | None = None) -> None:
    """The columns of a table written by one codec, read by the same or, for joins and stacks, from the path by the operator."""

    def run(spark, sf_dir):
        path = f"{files.scratch(spark)}/{name}-{uuid.uuid4().hex}"
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        files.write(pipeline(f"select {columns}").apply(df).df, way, path, **(args or {}))
        out = pipeline(text.replace("PATH", path)).run(spark, input_file=path) if text.startswith(way) else pipeline(text.replace("PATH", path)).apply(spark.read.parquet(f"{sf_dir}/nation.parquet"), order="n_nationkey")
        return out.df.select(*[F.col(f"`{c}`") for c in out.df.columns if not c.startswith("__")])

    QUERIES[name] = run
    SQL[name] = sql


_file_query("codec_csv", "part", "p_partkey,p_name,p_retailprice", "csv", "csv | derive n=p_partkey+1 p=round(p_retailprice) | select p_partkey,p_name,n,p", "SELECT p_partkey, p_name, p_partkey + 1 AS n, round(printf('%.6g', p_retailprice)::DOUBLE)::BIGINT AS p FROM part")
_file_query("codec_csv_quoted", "documents", "doc_id,text", "csv", "csv delimiter=; | derive n=len(text) | select doc_id,n", "SELECT doc_id, nullif(strlen(text), 0) AS n FROM documents", {"delimiter": ";"})
_file_query("codec_jsonl", "part", "p_partkey,p_name,p_retailprice", "jsonl", "jsonl | filter p_partkey>100", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey > 100")
_file_query("codec_text", "part", "p_name,p_brand", "text", "text | grep a", "SELECT p_name || chr(9) || p_brand AS _line FROM part WHERE contains(p_name || chr(9) || p_brand, 'a')")
_file_query("codec_parquet", "part", "p_partkey,p_size", "parquet", "parquet | filter p_size>10", "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
_file_query("join_file", "region", "r_regionkey,r_name", "csv", "join PATH on n_regionkey=r_regionkey | select n_name,r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_file_query("stack_file", "region", "r_regionkey,r_name", "csv", "select n_nationkey,n_name | stack PATH", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")


def _table(spark, sf_dir):
    """The Markdown table of a result, line by line."""
    text = pipeline("select n_nationkey,n_name | sort n_nationkey | table max_width=8 max_rows=20").apply(spark.read.parquet(f"{sf_dir}/nation.parquet"), order="n_nationkey").output_text
    return spark.createDataFrame([(k, x) for k, x in enumerate(text.splitlines())], "k long, line string")


QUERIES["codec_table"] = _table
SQL["codec_table"] = """WITH r AS (SELECT n_nationkey::VARCHAR AS a, left(n_name, 8) AS b, row_number() OVER (ORDER BY n_nationkey) + 1 AS k FROM nation ORDER BY n_nationkey LIMIT 20),
c AS (SELECT a, b, k FROM r UNION ALL SELECT 'n_nation', 'n_name', 0), w AS (SELECT max(length(a)) AS wa, max(length(b)) AS wb FROM c)
SELECT k, '| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' |' AS line FROM c, w UNION ALL SELECT 1, '| ' || repeat('-', wa::INT) || ' | ' || repeat('-', wb::INT) || ' |' FROM w"""
