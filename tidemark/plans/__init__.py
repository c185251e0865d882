"""Registered queries; importing the package registers them all."""

from . import queries  # noqa: F401  first: the others register there
from . import ingest  # noqa: F401
from . import reports  # noqa: F401
from . import live  # noqa: F401  after reports: it takes SQL from there
from . import streams  # noqa: F401
from . import windows  # noqa: F401
from . import requests  # noqa: F401
from . import facts  # noqa: F401
from . import states  # noqa: F401
from . import batches  # noqa: F401
from . import imports  # noqa: F401
from . import intake  # noqa: F401  after ingest and batches
from . import upkeep  # noqa: F401  last: it takes SQL from others
