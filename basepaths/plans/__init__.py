"""All registered queries; importing the modules fills the registry."""

from basepaths.plans.registry import QUERIES, oracle_sql  # noqa: F401

from basepaths.plans import value  # noqa: F401,E402 - intermediates first
from basepaths.plans import expectancy  # noqa: F401,E402
from basepaths.plans import exposure  # noqa: F401,E402
from basepaths.plans import positional  # noqa: F401,E402
from basepaths.plans import scouting  # noqa: F401,E402
from basepaths.plans import boards  # noqa: F401,E402
from basepaths.plans import normalization  # noqa: F401,E402
from basepaths.plans import documents  # noqa: F401,E402
