"""A record of a run: what was run, in a form that equal plans share, and when."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame

from . import nodes as N

VERSION = "0.1.0"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plan_hash(plan: N.Plan) -> str:
    return _hash(plan.canonical())


@dataclasses.dataclass(frozen=True)
class RunManifest:
    """Hashes are of the plan alone, so settings and credentials never enter them."""

    id: str
    plan_hash: str
    order_hash: str
    schema_hash: str | None
    engine_version: str
    started_ms: int
    finished_ms: int | None = None
    inputs_digest: str | None = None
    outputs_digest: str | None = None

    def finished(self, df: DataFrame, inputs_digest: str | None = None, outputs_digest: str | None = None) -> RunManifest:
        return dataclasses.replace(self, schema_hash=_hash(df.schema.json()), finished_ms=int(time.time() * 1000), inputs_digest=inputs_digest, outputs_digest=outputs_digest)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunManifest:
        return cls(**json.loads(text))


def started(plan: N.Plan) -> RunManifest:
    order = " ".join(type(s).__name__ for s in plan.steps)
    return RunManifest(str(uuid.uuid4()), plan_hash(plan), _hash(order), None, VERSION, int(time.time() * 1000))


def same_plan(manifest: RunManifest, plan: N.Plan) -> bool:
    """Whether a recorded run was of this plan."""
    return manifest.plan_hash == plan_hash(plan)


def inputs_digest(spark, paths: list[str]) -> str:
    """A digest of the input files' places, lengths and times of change, without reading them."""
    from ..sources.storage import Storage

    store = Storage(spark)
    return _hash(" ".join(store.etag(p) for p in sorted(paths)))


def content_digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: count, sum and xor of row hashes, in one aggregate."""
    from pyspark.sql import functions as F

    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, total, mixed = df.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return _hash(f"{n} {total} {mixed} {df.schema.simpleString()}")
