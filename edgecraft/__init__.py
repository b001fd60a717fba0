"""edgecraft: skill-gap analytics and tiered practice recommendations on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame``; nothing inside an
operator triggers an action except model fits (Spark ML) and documented
one-row scalar lookups.
"""

from edgecraft.config import Config

__all__ = ["Config"]
