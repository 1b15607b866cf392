"""What a statement costs: its plan by kinds of operators, a name for its shape, and how long it ran."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Kinds that are counted, each by what its name in a plan holds.
KINDS = {"scans": "Scan ", "exchanges": "Exchange", "joins": "Join", "aggregates": "Aggregate", "sorts": "Sort ", "windows": "Window", "python": "Arrow|Pandas|Python"}


@dataclass
class Profile:
    name: str  # the shape of the plan: equal for statements that differ in their values alone
    kinds: dict[str, int]
    rows: int | None = None
    seconds: float | None = None


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def profile(df: DataFrame, run: bool = False) -> Profile:
    """The profile of a statement; run: also its rows and seconds, without keeping the rows."""
    text = plan(df)
    shape = re.sub(r"#\d+L?|\[id=[^\]]*\]|\[plan_id=[^\]]*\]|-?\b\d+(\.\d+)?\b|InMemoryFileIndex[^\n]*|Location:[^\n]*", "?", text)
    shape = re.sub(r"(= |, |\()[^(),\n]*\?", r"\1?", shape)
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in text.split("\n")]
    kinds = {kind: sum(bool(re.match(rf"[A-Za-z ]*({pattern})", line)) for line in lines) for kind, pattern in KINDS.items()}
    out = Profile(hashlib.sha256(shape.encode()).hexdigest()[:16], kinds)
    if run:
        began = time.time()
        out.rows = df.count()
        out.seconds = time.time() - began
    return out


def superlinear(small: Profile, large: Profile, factor: float = 2.0, bound: float = 1.5) -> bool:
    """Whether a statement over `factor` times the rows took more than `bound` times that much longer."""
    return bool(small.seconds) and large.seconds / small.seconds > factor * bound
