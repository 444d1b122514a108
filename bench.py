"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from penmark.plans.queries import QUERIES
from penmark.session import build_session
from penmark.sources import sample

REPEATS = 2  # the first run counts, the second is reported beside it

HEADLINE = [
    "style_indices",
    "corpus_4wings",
    "corpus_2wings",
    "modal_label",
    "token_stats",
    "function_word_freq",
    "word_length_curve",
    "sentence_length_curve",
    "lexicon_encode",
    "stress_encode",
    "word_ngram_df",
    "tfidf_word",
    "tfidf_char",
    "chi2_top",
    "feature_table",
    "folds",
    "f1_macro_micro",
    "compare_methods",
    "anova",
    "spearman",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cores, int(cores), **{"spark.driver.memory": "8g"})
    # Start the JVM's code paths on a small read, outside the timed part.
    spark.read.parquet(f"{folder}/labels.parquet").groupBy("quality").count().collect()
    seconds, again = {}, {}
    start = time.perf_counter()
    sample.lexicon(spark)
    seconds["lexicon_build"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], again[name] = round(runs[0], 3), round(runs[-1], 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "second_run": again, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
