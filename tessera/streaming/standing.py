"""Change feeds and standing queries.

A standing query keeps its last answer as a checkpoint and turns each batch of
committed writes into signed facts: rows that came (+1) and rows that went (-1).
Feeds over Parquet logs use Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.errors import Refusal
from tessera.operators.lineage import cut
from tessera.plans.database import Database, difference
from tessera.plans.engine import components, disjuncts
from tessera.plans.parser import RuleAtom, SearchAtom, StoredAtom, parse


class Standing:
    def __init__(self, db: Database, text: str):
        self.db, self.text, self.program = db, text, parse(text)
        self._refuse()
        self.reads = sorted({a.name for r in self.program.rules for d in disjuncts(r.body) for a in d if isinstance(a, StoredAtom)} if all(r.body is not None for r in self.program.rules) else [])
        self.dirty = False
        for name in self.reads:
            db.register_callback(name, lambda *_: setattr(self, "dirty", True))
        self.answer = cut(db.engine.run(parse(text)))

    def _refuse(self) -> None:
        uses: dict[str, set] = {}
        for r in self.program.rules:
            if r.algo:
                raise Refusal("a standing query cannot call an algorithm")
            for d in disjuncts(r.body) if r.body is not None else []:
                for a in d:
                    if isinstance(a, SearchAtom) or isinstance(a, StoredAtom) and a.read.kind != "current":
                        raise Refusal("a standing query reads current relations only")
                    if isinstance(a, RuleAtom):
                        uses.setdefault(r.name, set()).add(a.name)
        for group in components("?", uses):
            if len(group) > 1 or group[0] in uses.get(group[0], ()):
                raise Refusal("a standing query cannot recurse")

    def apply_pending(self) -> DataFrame:
        """Signed facts since the last call."""
        if not self.dirty:
            return self.answer.limit(0).withColumn("_sign", self._zero())
        now = cut(self.db.engine.run(parse(self.text)))
        out = cut(difference(self.answer, now))
        self.answer, self.dirty = now, False
        return out

    @staticmethod
    def _zero():
        from pyspark.sql import functions as F

        return F.lit(0).cast("bigint")


def change_feed(db: Database, relation: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Stream a relation's version log; ``on_batch`` gets every committed batch once."""
    r = db.relation(relation)
    stream = db.spark.readStream.schema(db._log_schema(r)).option("recursiveFileLookup", "true").parquet(f"{db.root}/{relation}")
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
