from .dsl import DslError, parse_dsl  # noqa: F401
from .plan import Plan, PlanError, Step, param  # noqa: F401
from .recipes import RECIPES, find_recipe  # noqa: F401
