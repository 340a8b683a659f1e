"""Dispatch of actions by name: contracts are checked before a plan is built, writes need approval, and every call leaves a row in a log.

    call = Dispatcher(spark, log="/shared/evidence", developer=True)("prompts.search", docs, query="json")
    call.data, call.error, call.evidence

The log is append-only: a small file for each call, or, with `keep` rows in hand, for so many calls."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.actions import ACTIONS

LOG = "evidence_id string, at timestamp, action string, input_hash string, result string, duration_ms double, error string"
UNKNOWN = "(unknown)"
MODES = ("conservative", "balanced", "aggressive")

Check = Callable[[dict], str | None]


def text(name: str, filled: bool = True) -> Check:
    """A required string, not blank if it must be filled."""
    wanted = "required non-empty string" if filled else "required string"
    return lambda x: None if isinstance(x.get(name), str) and (x[name].strip() or not filled) else f"{name}: {wanted}"


def number(name: str, least: int, most: int | None = None) -> Check:
    wanted = f"optional number {least}-{most}" if most else f"optional number >= {least}"

    def check(x: dict) -> str | None:
        v = x.get(name)
        return None if v is None or (isinstance(v, (int, float)) and not isinstance(v, bool) and v >= least and (most is None or v <= most)) else f"{name}: {wanted}"

    return check


def one_of(name: str, allowed: tuple[str, ...], optional: bool = False) -> Check:
    listed = " | ".join(f"'{a}'" for a in allowed)
    return lambda x: None if x.get(name) in allowed or (optional and x.get(name) is None) else f"{name}: {'optional' if optional else 'must be'} {listed}"


def texts(name: str) -> Check:
    return lambda x: None if x.get(name) is None or (isinstance(x[name], (list, tuple)) and all(isinstance(t, str) for t in x[name])) else f"{name}: optional string array"


def fixture(x: dict) -> str | None:
    name = x.get("name")
    if not isinstance(name, str) or not name.strip():
        return "name: required non-empty string"
    return "name: path traversal rejected (must be simple filename)" if any(p in name for p in ("..", "/", "\\", "\0")) else None


def table(name: str, *columns: str) -> Check:
    return lambda x: None if isinstance(x.get(name), DataFrame) and set(columns) <= set(x[name].columns) else f"{name}: table with {', '.join(columns)} required"


@dataclass(frozen=True)
class Contract:
    """needs and gives: columns of the documents and of the result. inputs: checks of what is passed besides. write: changes something, and needs approval."""

    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    inputs: tuple[Check, ...] = ()
    risk: str = "low"
    write: bool = False


CONTRACTS = {
    "prompts.search": Contract(("id", "file_path", "title", "category", "tags", "content", "description"), ("id", "total"), (text("query"), number("limit", 1, 1000), number("offset", 0))),
    "prompts.get": Contract(("id",), ("id",), (text("value", filled=False),)),
    "prompts.score": Contract(("id", "content"), ("id", "quality_score", "hygiene_score", "context_score", "score")),
    "prompts.detect_artifacts": Contract(("content",), ("artifacts", "hygiene_score", "hygiene_status", "categories")),
    "prompts.optimize": Contract(("content",), ("optimized", "changes", "score_before", "score_after"), (one_of("mode", MODES),)),
    "prompts.create": Contract((), (), (text("title"), text("folder"), texts("tags")), "medium", True),
    "prompts.update": Contract((), (), (text("title"), text("folder"), texts("tags")), "high", True),
    "collections.list": Contract(("category", "overall_score"), ("category", "n_docs", "mean_score")),
    "qa.load_fixture": Contract((), ("content",), (text("folder"), fixture)),
    "qa.compare_score": Contract(("id", "content"), ("a", "b", "delta", "winner"), (table("pairs", "a", "b"),)),
    "blueprints.detect": Contract(("content",), ("content_class",)),
    "blueprints.evaluate": Contract(("content",), ("content_class", "blueprint_score")),
    "blueprints.optimize": Contract(("content",), ("optimized", "changes"), (one_of("mode", MODES),)),
}


@dataclass
class Call:
    """What a call gave: data, or an error; and the id of its row in the log."""

    success: bool
    data: object = None
    error: str | None = None
    evidence: str = ""


def input_hash(inputs: dict) -> str:
    """The 31-based hash of the inputs' JSON over UTF-16 units, 32 bits; tables count by their columns."""
    plain = {k: list(v.columns) if isinstance(v, DataFrame) else v for k, v in inputs.items()}
    units = json.dumps(plain, ensure_ascii=False, separators=(",", ":"), default=str).encode("utf-16-le", "surrogatepass")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "little")) & 0xFFFFFFFF
    return f"{h:08x}"


@dataclass
class Dispatcher:
    """developer: whether actions may be used at all. approve: asked with name and risk before a write; without it, writes are blocked."""

    spark: SparkSession
    log: str
    developer: bool = False
    approve: Callable[[str, str], bool] | None = None
    keep: int = 1
    rows: list[tuple] = field(default_factory=list, repr=False)

    def __call__(self, action: str, docs: DataFrame | None = None, **inputs: object) -> Call:
        begin = time.perf_counter()

        def done(result: str, error: str | None = None, name: str = action, data: object = None) -> Call:
            id_ = uuid.uuid4().hex
            self.rows.append((id_, datetime.now(timezone.utc), name, input_hash(inputs), result, (time.perf_counter() - begin) * 1000, error))
            if len(self.rows) >= self.keep:
                self.flush()
            return Call(result in ("success", "approved"), data, error, id_)

        contract = CONTRACTS.get(action)
        if contract is None:
            return done("error", f'Unknown action: "{action}". Valid actions include: {", ".join(CONTRACTS)}.', UNKNOWN)
        if not self.developer:
            return done("blocked", "Developer mode not enabled")
        missing = [c for c in contract.needs if docs is None or c not in docs.columns]
        errors = ([f"documents: columns {', '.join(missing)} required"] if missing else []) + [e for check in contract.inputs if (e := check(inputs))]
        if errors:
            return done("error", f"Input validation failed: {'; '.join(errors)}")
        if contract.write:
            if self.approve is None:
                return done("blocked", "Write action requires approval but no approval provider is registered.")
            try:
                approved = self.approve(action, contract.risk)
            except Exception as error:  # noqa: BLE001  (whatever the provider raises is in the log)
                return done("error", f"Approval provider threw: {error}")
            if not approved:
                return done("denied", "User denied the write action approval request.")
            done("approved")
        try:
            data = ACTIONS[action](docs, **inputs)
        except Exception as error:  # noqa: BLE001  (a failing action is a row in the log, and an error in the result)
            return done("error", str(error))
        lost = [c for c in contract.gives if not isinstance(data, DataFrame) or c not in data.columns]  # what gives no columns may be no table
        if lost:
            return done("error", f"Output validation failed: {', '.join(lost)} missing")
        return done("success", data=data)

    def flush(self) -> None:
        """Writes the rows in hand."""
        if self.rows:
            self.spark.createDataFrame(self.rows, LOG).coalesce(1).write.mode("append").parquet(self.log)
            self.rows = []


def evidence(spark: SparkSession, log: str) -> DataFrame:
    """The log; without calls, no rows."""
    if not storage.exists(spark, log):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log)


def of_action(log: DataFrame, action: str) -> DataFrame:
    return log.where(F.col("action") == action)
