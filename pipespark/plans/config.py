"""Settings, in layers: defaults, environment, the pipeline's ``config``, command line; and what they become in Spark.

Memory, spilling and parallelism are Spark's, so they are set when a session is made; there is no cap per query.  Cloud
credentials belong to Hadoop's configuration and never enter a manifest.
"""

from __future__ import annotations

import dataclasses
import os
import warnings
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..errors import ConfigError

PREFIX = "PIPESPARK_"


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    mem_cap_bytes: int = 512 << 20
    block_size_hint: int | None = None
    max_spill_concurrency: int = 4
    seed: int | None = None
    max_parallel_tasks: int = 4
    spill_dir: str | None = None
    spill_uri: str | None = None
    spill_aws_region: str | None = None
    spill_aws_access_key_id: str | None = None
    spill_aws_secret_access_key: str | None = None
    spill_aws_session_token: str | None = None
    spill_gcs_service_account: str | None = None
    spill_azure_access_key: str | None = None
    spill_retry_max_retries: int = 3
    spill_retry_initial_backoff_ms: int = 200
    spill_retry_max_backoff_ms: int = 5_000

    def updated(self, values: Mapping[str, object], where: str) -> EngineConfig:
        """With the values that aren't None; unknown names are warned of and left out."""
        kinds = {f.name: f.type for f in dataclasses.fields(self)}
        new = {}
        for k, v in values.items():
            if v is None:
                continue
            if k not in kinds:
                warnings.warn(f"{where}: unknown setting '{k}' is ignored", stacklevel=2)
                continue
            try:
                new[k] = int(v) if "int" in str(kinds[k]) else str(v)
            except ValueError as e:
                raise ConfigError(f"{where}: '{k}' must be a whole number, not '{v}'") from e
        out = dataclasses.replace(self, **new)
        if out.spill_uri and out.spill_uri.split(":")[0] not in ("s3", "s3a", "gs", "gcs", "azure", "azblob", "abfss", "file", "hdfs"):
            raise ConfigError(f"unsupported spill scheme in '{out.spill_uri}'", hints=["use s3, gs, azure or file"])
        return out

    @classmethod
    def layered(cls, pipeline: Mapping[str, object] | None = None, flags: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        own = {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}
        return cls().updated(own, "environment").updated(pipeline or {}, "pipeline config").updated(flags or {}, "command line")

    def spark_conf(self) -> dict[str, str]:
        out = {
            "spark.driver.memory": f"{max(512, self.mem_cap_bytes >> 20)}m",  # below half a gigabyte a driver doesn't start
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.task.maxFailures": str(1 + self.spill_retry_max_retries),
        }
        if self.spill_dir:
            out["spark.local.dir"] = self.spill_dir
        if self.spill_uri and not self.spill_uri.startswith("file"):
            warnings.warn("spill files are local in Spark; spill_uri is taken as the checkpoint folder", stacklevel=2)
            out["spark.checkpoint.dir"] = self.spill_uri
        if self.block_size_hint:
            out["spark.sql.files.maxPartitionBytes"] = str(self.block_size_hint)
        hadoop = {
            "fs.s3a.endpoint.region": self.spill_aws_region,
            "fs.s3a.access.key": self.spill_aws_access_key_id,
            "fs.s3a.secret.key": self.spill_aws_secret_access_key,
            "fs.s3a.session.token": self.spill_aws_session_token,
            "fs.gs.auth.service.account.json.keyfile": self.spill_gcs_service_account,
            "fs.azure.account.key": self.spill_azure_access_key,
        }
        return out | {f"spark.hadoop.{k}": v for k, v in hadoop.items() if v}

    def session(self, name: str = "pipespark") -> SparkSession:
        builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.caseSensitive", "true")
        if "MASTER" not in os.environ and not os.environ.get("SPARK_REMOTE"):
            builder = builder.master(f"local[{self.max_parallel_tasks}]")
        return builder.config(map=self.spark_conf()).getOrCreate()
