"""Named pipelines."""

# fixed values: names and pipelines that users call
RECIPES = {
    "profile": "csv | stats | csv",
    "preview": "csv | head 10 | csv",
    "schema": "csv | head 0 | csv",
    "summary": "csv | stats count,min,max,avg,stddev | csv",
    "count": "csv | stats count | csv",
    "cardinality": "csv | stats count,distinct | csv",
    "distro": "csv | stats min,p25,median,p75,max | csv",
    "freq": "csv | frequency | csv",
    "dedup": "csv | dedup | csv",
    "clean": "csv | trim | csv",
    "sample": "csv | sample 100 | csv",
    "head": "csv | head 20 | csv",
    "tail": "csv | tail 20 | csv",
    "csv2json": "csv | jsonl",
    "json2csv": "jsonl | csv",
    "tsv2csv": "csv delimiter=tab | csv",
    "csv2tsv": "csv | csv delimiter=tab",
    "look": "csv | table",
    "histogram": "csv | stats hist | csv",
    "hash": "csv | hash | csv",
    "samples": "csv | stats sample | csv",
}


def find_recipe(name: str) -> str | None:
    return RECIPES.get(name.strip().lower())
