"""English stop words as shipped with Spark ML (``StopWordsRemover``), read from the Spark jar
so that the Spark plan and the SQL oracle use the identical list without a JVM round trip."""

from __future__ import annotations

import functools
import glob
import os
import zipfile


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    import pyspark
    dirs = [os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    if os.environ.get("SPARK_HOME"):
        dirs.append(os.path.join(os.environ["SPARK_HOME"], "jars"))
    for jar in sorted(j for d in dirs for j in glob.glob(os.path.join(d, "spark-mllib_*.jar"))):
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return tuple(z.read(name).decode("utf-8").split())
    raise RuntimeError("Spark ML stop-word list not found")
