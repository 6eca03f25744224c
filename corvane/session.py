"""Session builder and engine configuration."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def build_session(app: str = "corvane", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that all operators assume: UTC, AQE, Arrow."""
    spark = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORVANE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@dataclass(frozen=True)
class EngineConfig:
    """Settings of the knowledge-data operators."""

    before_s: int = 120
    after_s: int = 300
    gap_s: int = 120
    section_chars: int = 6000
    block_chars: int = 5000
    overlap_chars: int = 200
    log_chars: int = 28000
    log_lines: int = 600
    paths: dict = field(default_factory=dict)


def resolve_config(values: dict, base_dir: str = "", env: dict | None = None) -> dict:
    """Replaces `${name}` by other top-level values and `${env:NAME}` by the environment ("" where unset), then makes *_dir and *_path absolute."""
    env = os.environ if env is None else env

    def text(s: str) -> str:
        s = re.sub(r"\$\{env:(\w+)\}", lambda m: env.get(m[1], ""), s)
        return re.sub(r"\$\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), s)

    def walk(x, name: str = ""):
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, name) for v in x]
        if isinstance(x, str):
            x = text(text(x))
            if base_dir and name.endswith(("_dir", "_path")) and x and not os.path.isabs(x):
                x = os.path.normpath(os.path.join(base_dir, x))
        return x

    return walk(values)


def set_by_path(config: dict, path: str, value: str) -> dict:
    """A copy of config with the value at a dotted path; true/yes/1 and false/no/0 are booleans, digits whole numbers."""
    low = value.strip().lower()
    typed = True if low in ("true", "yes", "1") else False if low in ("false", "no", "0") else int(value) if re.fullmatch(r"-?\d+", value.strip()) else value
    first, _, rest = path.partition(".")
    out = dict(config)
    out[first] = set_by_path(out.get(first) or {}, rest, value) if rest else typed
    return out
