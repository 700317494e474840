"""All registered queries."""

from reelframe.catalogue import geometry, pixels, quality, reports, selections, sequences  # noqa: F401
from reelframe.catalogue.base import QUERIES  # noqa: F401
