"""The reference's queries as DataFrame plans (``queries.PLANS``), the driver
registry (``registry``) and the DuckDB oracles (``oracle``)."""

from .queries import PLANS

__all__ = ["PLANS"]
