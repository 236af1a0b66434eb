"""BoostedTrees.java as SQL functions: compiled once an application by the compiler that Spark has for its own code, and sent to
the executors as a jar. boosting.py has the same fits in numpy.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.config import Settings

_SOURCE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "BoostedTrees.java")
_LOADED: dict[str, object] = {}  # by application: the loader of the compiled classes


def _loader(spark: SparkSession):
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    if app not in _LOADED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        with open(_SOURCE, encoding="utf-8") as f:
            compiler.cook(f.read())
        path = os.path.join(tempfile.mkdtemp(prefix="hourloom-jar-"), "boosted-trees.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        _LOADED[app] = compiler.getClassLoader()
    return _LOADED[app]


def function(spark: SparkSession, name: str, returns: str):
    """A public class of BoostedTrees as a function of the columns that its `call` takes."""
    made = _loader(spark).loadClass(f"hourloom.BoostedTrees${name}").getDeclaredConstructors()[0].newInstance(None)
    kind = spark._jsparkSession.parseDataType(T._parse_datatype_string(returns).json())
    spark._jsparkSession.udf().register(f"hourloom_{name}", made, kind)
    return lambda *cols: F.call_function(f"hourloom_{name}", F.struct(*cols))


def settings(params: dict, cfg: Settings, least_held: int) -> Column:
    """What a fit is told, as Settings in BoostedTrees.java reads it."""
    state = np.random.default_rng(params["seed"]).bit_generator.state["state"]
    halves = [h for v in (state["state"], state["inc"]) for h in (v >> 64, v & (1 << 64) - 1)]
    numbers = [params["maxDepth"], params["minInstancesPerNode"], params["patience"], params["maxIter"], params["bins"], cfg.val_days, least_held,
               params["stepSize"], params["subsamplingRate"], params["featureSubsetStrategy"]]
    return F.struct(
        F.array(*[F.lit(float(v)) for v in numbers]),
        F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, params["bins"])]),
        F.array(*[F.lit(h - (1 << 64) if h >> 63 else h).cast("long") for h in halves]),
    )
