"""A second evaluation of a query: without demand push-down, compared both ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.parser import StoredAtom, parse


def verify(db, text: str) -> tuple[str, str]:
    """``match``, ``mismatch`` or ``refused`` for a program, by re-running it without demand push-down."""
    p = parse(text)
    if p.write or p.order or p.limit is not None or p.offset:
        return "refused", "mutations, order and limits are not verified"
    for r in p.rules:
        for part in r.body.parts if r.body is not None else ():
            if isinstance(part, StoredAtom) and part.read.kind in ("spans", "delta", "delta_sys"):
                return "refused", "interval reads are not verified"
    a = db.engine.run(p)
    p2 = parse(text)
    p2.options["disable_magic_rewrite"] = True
    b = db.engine.run(p2)
    same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    return ("match" if same else "mismatch"), str(a.select(F.count(F.lit(1))).first()[0])
