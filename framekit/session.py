"""Session helpers: job descriptions, temporary folders, Python packages, versions."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pyspark
from pyspark import SparkFiles
from pyspark.sql import SparkSession

_DESCRIPTION = "spark.job.description"


def require_classic(spark: SparkSession, feature: str) -> SparkSession:
    """The session, if it has a JVM to talk to; over Spark Connect there is none."""
    if type(spark).__module__.startswith("pyspark.sql.connect"):
        raise RuntimeError(f"{feature} is not supported over Spark Connect; use a classic session")
    return spark


def set_job_description(spark: SparkSession, description: str | None, if_not_set: bool = False) -> str | None:
    """Set this thread's job description; returns the one before."""
    sc = require_classic(spark, "a job description").sparkContext
    before = sc.getLocalProperty(_DESCRIPTION)
    if not (if_not_set and before is not None):
        sc.setLocalProperty(_DESCRIPTION, description)
    return before


@contextlib.contextmanager
def job_description(spark: SparkSession, description: str, if_not_set: bool = False) -> Iterator[None]:
    """Jobs of the block carry the description; the one before returns afterwards."""
    before = set_job_description(spark, description, if_not_set)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty(_DESCRIPTION, before)


@contextlib.contextmanager
def append_job_description(spark: SparkSession, extra: str, separator: str = " - ") -> Iterator[None]:
    """Jobs of the block carry the present description and the extra one."""
    before = require_classic(spark, "a job description").sparkContext.getLocalProperty(_DESCRIPTION)
    with job_description(spark, extra if before is None else f"{before}{separator}{extra}"):
        yield


def create_temporary_dir(spark: SparkSession, prefix: str) -> str:
    """A folder of the driver under Spark's file root, removed at exit."""
    require_classic(spark, "a temporary folder of the driver")
    path = tempfile.mkdtemp(prefix=prefix, dir=SparkFiles.getRootDirectory())
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def install_pip_package(spark: SparkSession, *arguments: str) -> None:
    """``pip install`` the arguments into an archive and make it importable on driver and executors."""
    top = create_temporary_dir(spark, "pip-")
    target = os.path.join(top, "packages")
    subprocess.run([sys.executable, "-m", "pip", "install", "--target", target, *arguments], check=True)
    name = os.path.basename(top)
    archive = shutil.make_archive(os.path.join(top, name), "zip", target)
    spark.sparkContext.addPyFile(archive)


def install_poetry_project(spark: SparkSession, *projects: str, poetry: str | list[str] = "poetry", pip_arguments: tuple[str, ...] = ()) -> None:
    """Build each project's wheel with Poetry and install it like a pip package."""
    command = [poetry] if isinstance(poetry, str) else list(poetry)
    wheels = []
    for project in projects:
        out = create_temporary_dir(spark, "poetry-")
        subprocess.run([*command, "build", "--format", "wheel", "--output", out, "--directory", project], check=True)
        built = [os.path.join(out, f) for f in os.listdir(out) if f.endswith(".whl")]
        if not built:
            raise RuntimeError(f"Poetry built no wheel for {project}")
        wheels += built
    install_pip_package(spark, *wheels, *pip_arguments)


def version_info(spark: SparkSession | None = None) -> dict[str, str]:
    """Library and Spark versions; with a session, the running cluster's too."""
    from framekit import __version__

    build = tuple(pyspark.__version__.split(".")[:2])
    out = {"framekit": __version__, "pyspark": pyspark.__version__, "spark_major": build[0], "spark_compat": ".".join(build)}
    return out if spark is None else {**out, "spark": spark.version}
