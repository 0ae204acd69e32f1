"""Sessions, and code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def build_session(app: str = "quernlight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the semantic layer counts on: UTC, ANSI arithmetic, case-insensitive names, AQE."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.caseSensitive": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless their Python finds it already."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    system = spark._jvm.System
    paths = [system.getProperty("user.dir") or "", *(system.getenv("PYTHONPATH") or "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == str(ROOT) or os.path.isdir(os.path.join(p, "quernlight")) for p in paths if p):
        return
    target = Path(tempfile.mkdtemp(prefix="quernlight-")) / "quernlight.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted((ROOT / "quernlight").rglob("*.py")):
            out.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))


_SCRATCH: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); where it is unset, in a temporary one in local mode, an error elsewhere."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quernlight-"))
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
