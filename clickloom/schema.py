"""Schemas, the event-type dictionary and the named variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Event types by code, in the order in which results list them, and their share in the overall recall.
EVENT_TYPES = ("clicks", "carts", "orders")
RECALL_WEIGHTS = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}

EVENTS = StructType([StructField("session", LongType()), StructField("aid", LongType()), StructField("ts", LongType()), StructField("type", StringType())])
SCORES = StructType([StructField("aid_key", LongType()), StructField("aid_future", LongType()), StructField("score", LongType())])
INDEX = StructType([StructField("aid_key", LongType()), StructField("candidates", ArrayType(LongType())), StructField("scores", ArrayType(LongType()))])
RECENT = StructType([StructField("session", LongType()), StructField("recent_aids", ArrayType(LongType()))])
#: The columns of the run ledger.
LEDGER = StructType(
    [
        StructField(c, StringType())
        for c in ("timestamp", "exp_name", "pipeline", "status", "config_path", "enable_convisitation", "enable_nn", "enable_fusion", "enable_ranker", "score", "notes")
    ]
)
DAY_MS = 86_400_000
RECENT_DAYS = 14
TOP_ITEMS = 20


@dataclass(frozen=True)
class Variant:
    """Weights of the current event by type, lookback, candidates kept for each item, and whether old events go."""

    name: str
    clicks: int
    carts: int
    orders: int
    lookback: int = 2
    topk: int = 100
    recent: bool = False

    @property
    def weights(self) -> dict[str, int]:
        return {"clicks": self.clicks, "carts": self.carts, "orders": self.orders}


#: The named variants.
VARIANTS = {
    v.name: v
    for v in (
        Variant("base", 1, 3, 6),
        Variant("v12", 1, 3, 6, recent=True),
        Variant("v13", 0, 3, 6),
        Variant("v14", 1, 9, 1),
        Variant("v15", 1, 0, 0),
        Variant("v16", 1, 3, 6, lookback=5),
        Variant("v17", 1, 9, 6, lookback=20),
        Variant("v18", 1, 15, 20),
        Variant("v19", 1, 9, 1, topk=300),
        Variant("v20", 1, 3, 6, topk=300),
    )
}


def variant(name: str) -> Variant:
    """The variant of this name; another name is an error."""
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}; known: {', '.join(VARIANTS)}")
    return VARIANTS[name]
