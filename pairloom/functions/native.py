"""difflib's edits of all pairs of some rows, by a class for the JVM that Spark's own Janino compiles: Edits.java."""

from __future__ import annotations

import importlib.resources
import os
import sys
import tempfile
import weakref
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Least characters of a common run that is looked up (at most 8); runs of a pair before difflib's own search takes over.
RUN, MOST = 6, 4 << 20
#: Words beside which an edit changes the envelope of a text.
MARKERS = ("date", "created", "updated")
KIND = "array<struct<a: bigint, b: bigint, value: bigint>>"

_known: weakref.WeakSet = weakref.WeakSet()


def _characters(test) -> str:
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if test(c))


def _registered(spark: SparkSession) -> None:
    """The class goes to the session and, as a jar, to its executors."""
    if spark in _known:
        return
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(importlib.resources.files(__package__).joinpath("Edits.java").read_text(encoding="utf-8"))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="pairloom-"))
    with zipfile.ZipFile(f"{folder}/pairloom-edits.jar", "w") as jar:
        for entry in compiler.getBytecodes().entrySet():
            jar.writestr(f"{entry.getKey().replace('.', '/')}.class", bytes(entry.getValue()))
    spark.sql(f"ADD JAR '{folder}/pairloom-edits.jar'")
    made = spark._jsparkSession.sharedState().jarClassLoader().loadClass("Edits").newInstance()
    kind = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(KIND)
    spark._jsparkSession.udf().register("pairloom_edits", made, kind)
    _known.add(spark)


def edits(spark: SparkSession, mode: str, rows: Column, same: Column, *, run: int = RUN, most: int = MOST) -> Column:
    """a, b (the smaller id first) and a value for each pair of ``rows``, an array of structs: id, own, text and for ``verdict``
    script (1 or 2 if it tells) and meta (null is never equal). ``same``: pairs within one block, else of rows with different own.

    mass: what difflib's opcodes insert, delete or replace; hulls: edits between characters, joined where at most 12 lie between them;
    verdict: 0 other scripts, 1 and 2 equal tokens with equal and other meta, 3 plus 1 if an edit is of facts plus 2 if one is another.
    """
    if not 2 <= run <= 8:
        raise ValueError("runs of 2 to 8 characters")
    _registered(spark)
    words = mode == "verdict"
    spec = [mode, str(run), str(most), _characters(str.isdigit) if words else "", _characters(str.isspace) if words else "", " ".join(MARKERS)]
    return F.call_udf("pairloom_edits", rows, same, F.array(*map(F.lit, spec)), F.lit(None).cast("int"))
