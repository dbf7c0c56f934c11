"""Query catalogue: importing this package registers every query key."""
from . import registry  # noqa: F401
from . import feature_plans  # noqa: F401
from . import eval_plans  # noqa: F401
from . import grid_plans  # noqa: F401
from . import score_plans  # noqa: F401
from . import sheet_plans  # noqa: F401
from . import selection_plans  # noqa: F401
from . import source_plans  # noqa: F401
from . import stream_plans  # noqa: F401
from . import ml_plans  # noqa: F401

from .registry import ORACLES, QUERIES  # noqa: F401,E402
