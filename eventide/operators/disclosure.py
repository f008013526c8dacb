"""Suppression of small cells in released counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CELL = 10


def hidden(n: Column, n_positive: Column | None = None, floor: int = MIN_CELL) -> Column:
    """Whether a cell, or one of its two sides, is over zero but under the floor."""
    small = lambda c: (c > 0) & (c < floor)
    return small(n) if n_positive is None else small(n) | small(n_positive) | small(n - n_positive)


def band(n: Column, floor: int = MIN_CELL) -> Column:
    """Coarse size of a cell."""
    return F.when(n == 0, "0").when(n < floor, f"<{floor}").when(n < 100, f"{floor}-99").when(n < 1000, "100-999").otherwise(">=1000")


def suppress(df: DataFrame, siblings: Sequence[str], cell: str, n: str, floor: int = MIN_CELL) -> DataFrame:
    """``df`` with ``shown``: the count as text, or '<floor' for small cells and, where only one sibling is small, for the smallest other one too."""
    small = df.withColumn("__h", hidden(F.col(n), floor=floor))
    part = Window.partitionBy(*siblings)
    alone = F.sum(F.col("__h").cast("int")).over(part) == 1
    rank = F.row_number().over(part.orderBy(F.col("__h").cast("int"), F.when(F.col(n) > 0, 0).otherwise(1), n, cell))
    also = alone & ~F.col("__h") & (rank == 1)
    return small.withColumn("shown", F.when(F.col("__h") | also, f"<{floor}").otherwise(F.col(n).cast("string"))).drop("__h")


def fixpoint(cells: dict, equations: Sequence[Sequence], floor: int = MIN_CELL, sticky: Sequence = ()) -> set:
    """Cells to hide (driver side, on a released table's few cells): small and sticky ones, and more of every equation in which exactly one is hidden, until none is left.

    ``equations`` list cells of which the others give away a single one.
    """
    out = {k for k, n in cells.items() if 0 < n < floor} | set(sticky)
    while True:
        more = set()
        for eq in equations:
            hid = [c for c in eq if c in out]
            if len(hid) == 1 and len(eq) > 1:
                more.add(min((c for c in eq if c not in out), key=lambda c: (cells[c] == 0, cells[c], str(c))))
        if not more:
            return out
        out |= more


def sign(payload: object, key: bytes) -> str:
    import hashlib
    import hmac

    from eventide.sources.sinks import canonical_json

    return hmac.new(key, canonical_json(payload).encode(), hashlib.sha256).hexdigest()


def verify(payload: object, key: bytes, signature: str) -> bool:
    import hmac

    return hmac.compare_digest(sign(payload, key), signature)


def append_log(path: str, entry: dict, key: bytes) -> str:
    """Appends an entry that is signed together with the one before; returns its link."""
    import json
    from pathlib import Path

    file = Path(path)
    lines = file.read_text().splitlines() if file.exists() else []
    before = json.loads(lines[-1])["link"] if lines else ""
    link = sign([before, entry], key)
    with file.open("a") as f:
        f.write(json.dumps({"entry": entry, "link": link}, sort_keys=True) + "\n")
    return link


def verify_log(path: str, key: bytes) -> bool:
    """Whether every entry of a log follows from the one before."""
    import json
    from pathlib import Path

    before = ""
    for line in Path(path).read_text().splitlines():
        x = json.loads(line)
        if not verify([before, x["entry"]], key, x["link"]):
            return False
        before = x["link"]
    return True


def waterfall(steps: DataFrame, order: str, n: str, floor: int = MIN_CELL) -> DataFrame:
    """A cohort waterfall's ``steps`` (order, n of those left) with ``removed`` and both as ``shown`` texts.

    What is left after a step and what it removes add up to what was left
    before, so wherever one hidden count follows from the shown ones, the
    smallest other count of that equation that is not zero is hidden too,
    until no hidden count follows.  Steps are a report's few rows.
    """
    rows = [(r[order], r[n]) for r in steps.orderBy(order).collect()]
    cells, equations = {}, []
    for i, (o, left) in enumerate(rows):
        cells["left", o] = left
        if i:
            cells["removed", o] = rows[i - 1][1] - left
            equations.append([("left", rows[i - 1][0]), ("left", o), ("removed", o)])
    hidden_ = fixpoint(cells, equations, floor)

    def shown(kind: str, o: object) -> str | None:
        v = cells.get((kind, o))
        return None if v is None else str(v) if (kind, o) not in hidden_ else f"<{floor}" if 0 < v < floor else "hidden"

    kind = steps.schema[order].dataType.simpleString()
    return steps.sparkSession.createDataFrame([(o, shown("left", o), shown("removed", o)) for o, _ in rows], f"{order} {kind}, left_shown string, removed_shown string")


def check_schema(payload: dict, allowed: dict[str, type | tuple], cell: dict[str, type | tuple]) -> None:
    """Error unless a report has only allowed fields of the right types, and its ``cells`` too; every field is checked by name, so nothing new slips out."""
    for where, part, fields in [("report", payload, {**allowed, "cells": list}), *[(f"cell {i}", c, cell) for i, c in enumerate(payload.get("cells", []))]]:
        unknown = set(part) - set(fields)
        missing = set(fields) - set(part)
        wrong = [k for k in part if k in fields and (isinstance(part[k], bool) and fields[k] is not bool or not isinstance(part[k], fields[k]))]
        if unknown or missing or wrong:
            raise ValueError(f"{where}: unknown {sorted(unknown)}, missing {sorted(missing)}, wrong type {sorted(wrong)}")


EVALUABLE = "evaluable"


class Ledger:
    """Append-only record of the cells of every release, one JSON line each, and what may be released after them.

    A release is *intended* before it is published and *confirmed* after, so a
    crash between leaves it open and the same id may be tried again, while an
    id once confirmed may not.  Suppression is sticky: a cell hidden in any
    release, confirmed or not, stays hidden.  A cell whose size moves by less
    than the floor against a confirmed release is refused.
    """

    def __init__(self, path: str, floor: int = MIN_CELL) -> None:
        from pathlib import Path

        self.path, self.floor = Path(path), floor

    def entries(self) -> list[dict]:
        import json

        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []

    def confirmed(self) -> set[str]:
        return {e["confirmed"] for e in self.entries() if "confirmed" in e}

    def suppressed(self) -> set[str]:
        """Cells that must stay hidden."""
        return {e["cell"] for e in self.entries() if "cell" in e and e["status"] != EVALUABLE}

    def check(self, release: str, cells: Sequence[dict]) -> None:
        """Error if publishing ``cells`` (cell, status, n or None) would give something away."""
        done, hidden_ = self.confirmed(), self.suppressed()
        if release in done:
            raise ValueError(f"release {release} was published already")
        last = {e["cell"]: e for e in self.entries() if "cell" in e and e["release"] in done}
        for c in cells:
            before = last.get(c["cell"])
            if c["status"] == EVALUABLE and c["cell"] in hidden_:
                raise ValueError(f"cell {c['cell']} was hidden before")
            sizes = (before or {}).get("n"), c.get("n")
            if None not in sizes and (before["status"] == EVALUABLE) == (c["status"] == EVALUABLE) and 0 < abs(sizes[0] - sizes[1]) < self.floor:
                raise ValueError(f"cell {c['cell']} moved by less than {self.floor}")

    def _append(self, lines: Sequence[dict]) -> None:
        import json

        with self.path.open("a") as f:
            f.writelines(json.dumps(x, sort_keys=True) + "\n" for x in lines)

    def publish(self, release: str, cells: Sequence[dict], write) -> None:
        """Under a lock: check, record the intent, ``write()``, confirm."""
        import fcntl

        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self.check(release, cells)
            self._append([{"release": release, "cell": c["cell"], "status": c["status"], "n": c.get("n")} for c in cells])
            write()
            self._append([{"confirmed": release}])


def sticky_fixpoint(cells: dict, equations: Sequence[Sequence], ledger: Ledger, floor: int = MIN_CELL) -> set:
    """Cells to hide with those that the ledger holds hidden."""
    return fixpoint(cells, equations, floor, sticky=ledger.suppressed() & set(cells))


def ingest(report: dict, key: bytes, seen: set[str], outcome: str) -> dict:
    """The signed report of a site, if its signature holds, its outcome specification is the one asked for and its release is new."""
    payload = report["payload"]
    if not verify(payload, key, report["signature"]):
        raise ValueError("signature does not hold")
    if payload["outcome"] != outcome:
        raise ValueError("report is of another outcome")
    if payload["release"] in seen:
        raise ValueError(f"release {payload['release']} was ingested already")
    seen.add(payload["release"])
    return payload


def forest(cells: DataFrame, value: str, se: str, z: float = 1.959963984540054) -> DataFrame:
    """(site, status, value, lo, hi, weight): a row per site and, as site 'pooled', the inverse-variance mean; sites without numbers keep their status and weigh nothing."""
    ok = (F.col("status") == EVALUABLE) & (F.col(se) > 0)
    w = F.when(ok, 1 / F.pow(se, F.lit(2.0)))
    pooled = cells.agg(F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("s"))
    total = pooled.first()["w"] or 0.0
    row = lambda v, e: ((v - z * e).alias("lo"), (v + z * e).alias("hi"))
    sites = cells.select("site", "status", F.when(ok, F.col(value)).alias("value"), *[F.when(ok, c).alias(n) for c, n in zip((F.col(value) - z * F.col(se), F.col(value) + z * F.col(se)), ("lo", "hi"))], F.when(ok, w / F.lit(total or 1.0)).alias("weight"))
    mean, e = F.try_divide(F.col("s"), F.col("w")), 1 / F.sqrt("w")
    return sites.unionByName(pooled.where("w > 0").select(F.lit("pooled").alias("site"), F.lit(EVALUABLE).alias("status"), mean.alias("value"), *row(mean, e), F.lit(1.0).alias("weight")))
