"""A deterministic set of requirements to try things on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBSYSTEMS = ["navigation", "power", "thermal", "propulsion", "telemetry", "payload", "avionics", "ground"]
PATTERNS = [
    "The {s} unit shall report its state within {n} ms.", "The {s} module shall accept commands as specified in {ref}.", "After start-up, the {s} controller shall check {n} channels.", "The {s} service should log every fault.",
    "The {s} unit must not exceed {n} W.", "Once armed, the {s} unit shall follow {ref}.", "The {s} display may show the last {n} values.", "The {s} link shall be tested every {n} hours.",
]


def requirements(spark: SparkSession, n: int = 64) -> DataFrame:
    """(id, req_id, text, module): row k has subsystem k / 8 and pattern k mod 8, both in turn; {ref} is the id of the row before."""
    k = F.col("k")
    module = F.get(F.array(*[F.lit(s) for s in SUBSYSTEMS]), ((k / len(PATTERNS)).cast("int") % len(SUBSYSTEMS)))
    text = F.get(F.array(*[F.lit(p) for p in PATTERNS]), (k % len(PATTERNS)).cast("int"))
    name = lambda c: F.concat(F.lit("REQ-"), F.lpad(c.cast("string"), 5, "0"))
    for hole, value in (("{s}", module), ("{n}", (k * 7 % 90 + 10).cast("string")), ("{ref}", name(F.greatest(k - 1, F.lit(0))))):
        text = F.replace(text, F.lit(hole), value)
    return spark.range(n).select(F.col("id").alias("k")).select(k.alias("id"), name(k).alias("req_id"), text.alias("text"), module.alias("module"))
