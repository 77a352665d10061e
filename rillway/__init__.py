"""rillway: a Spark-native pipe language for analytics and data preparation."""

from .api import Pipeline, Result, codec, compile_dsl, expr, load_recipe, ops, pipeline, recipes, save_recipe, version  # noqa: F401
from .plans import param  # noqa: F401

__version__ = "0.1.0"
