"""Query catalog: importing this package registers every named query."""

from .catalog import REGISTRY, Query, register, rounded  # noqa: F401
from . import queries_core  # noqa: F401,E402
from . import queries_backtest  # noqa: F401,E402
from . import queries_data  # noqa: F401,E402
from . import queries_signals  # noqa: F401,E402
from . import queries_ml  # noqa: F401,E402
from . import queries_stream  # noqa: F401,E402
