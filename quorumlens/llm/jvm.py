"""Java classes for inner loops: compiled by the driver's JDK, sent to the executors as a jar, run on rows of a frame."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MODULE = "jdk.incubator.vector"
_LOADED: dict[tuple[str, str], tuple[Java, tempfile.TemporaryDirectory] | None] = {}


class Java:
    """A class of the driver's JVM whose objects are sent to the tasks."""

    def __init__(self, spark: SparkSession, kind):
        self.spark, self.kind = spark, kind

    def new(self, *values: bytes):
        """An object from the arguments of the class's only constructor."""
        given = self.spark.sparkContext._gateway.new_array(self.spark._jvm.Object, len(values))
        for i, value in enumerate(values):
            given[i] = value
        return self.kind.getConstructors()[0].newInstance(given)

    def rows(self, df: DataFrame, function, schema: str) -> DataFrame:
        """Rows that ``function``, a Java MapPartitionsFunction<Row, Row>, makes of the rows of each partition."""
        sql = self.spark._jvm.org.apache.spark.sql
        encoder = sql.Encoders.row(sql.types.StructType.fromDDL(schema))
        return type(df)(df._jdf.mapPartitions(function, encoder), self.spark)


def _compiled(spark: SparkSession, name: str, folder: str) -> Path | None:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    if not all(jvm.java.lang.ModuleLayer.boot().findModule(x).isPresent() for x in ("jdk.compiler", _MODULE)):
        return None
    path = jvm.java.lang.System.getProperty("java.class.path")
    words = ["-nowarn", "-proc:none", "--add-modules", _MODULE, "-cp", path, "-d", folder, str(Path(__file__).with_name(f"{name}.java"))]
    given = gateway.new_array(jvm.String, len(words))
    for i, word in enumerate(words):
        given[i] = word
    said = jvm.java.io.StringWriter()
    if jvm.com.sun.tools.javac.Main.compile(given, jvm.java.io.PrintWriter(said)):
        raise RuntimeError(f"{name}.java: {said.toString()}")
    jar = Path(folder, f"quorumlens-{name}.jar")
    with zipfile.ZipFile(jar, "w") as out:
        for file in sorted(Path(folder).glob("*.class")):
            out.write(file, file.name)
    return jar


def loaded(spark: SparkSession, name: str) -> Java | None:
    """The class in the Java file of this name beside this one; None where the JVM has no compiler or no vectors of its size."""
    context = getattr(spark, "_sc", None)
    if context is None:
        return None  # a session without a JVM of its own
    key = (context.applicationId, name)
    if key not in _LOADED:
        folder = tempfile.TemporaryDirectory(prefix="quorumlens-")
        jar = _compiled(spark, name, folder.name)
        _LOADED[key] = None
        if jar is not None:
            urls = context._gateway.new_array(spark._jvm.java.net.URL, 1)
            urls[0] = spark._jvm.java.io.File(str(jar.resolve())).toURI().toURL()
            above = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
            kind = spark._jvm.java.net.URLClassLoader(urls, above).loadClass(name)
            if kind.getMethod("usable", None).invoke(None, None):
                context._jsc.sc().addJar(str(jar.resolve()))
                _LOADED[key] = Java(spark, kind), folder
    found = _LOADED[key]
    return found and found[0]
