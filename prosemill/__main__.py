"""Command line: python -m prosemill PATH segments books; --debug-text shows one text's transitions."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(argv=None) -> int:
    p = argparse.ArgumentParser("prosemill")
    p.add_argument("path", nargs="?")
    p.add_argument("--overwrite-all", action="store_true")
    p.add_argument("--fail-fast", action="store_true")
    p.add_argument("--no-progress", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--stats-out", default="run_stats.json")
    p.add_argument("--clear-restart-log", action="store_true")
    p.add_argument("--max-cpus", type=int)
    p.add_argument("--sentence-length-stats", action="store_true")
    p.add_argument("--debug-joints", action="store_true")
    p.add_argument("--debug-text")
    p.add_argument("--debug-stdin", action="store_true")
    a = p.parse_args(argv)
    if a.debug_text is not None and a.debug_stdin:
        p.error("--debug-text and --debug-stdin exclude one another")
    if a.path is None and a.debug_text is None and not a.debug_stdin:
        p.error("a path is required")
    from pyspark.sql import SparkSession

    from prosemill.operators import segment as S
    from prosemill.sources import corpus as C

    builder = SparkSession.builder.appName("prosemill")
    if a.max_cpus:
        builder = builder.master(f"local[{max(1, a.max_cpus)}]")
    spark = builder.config("spark.ui.showConsoleProgress", str(not (a.no_progress or a.quiet)).lower()).getOrCreate()
    if a.path is None:
        text = a.debug_text if a.debug_text is not None else sys.stdin.read()
        for r in C.debug_lines(S.traced_sentences(C.literal(spark, text), ("path",))).orderBy("sent_index", "step").collect():
            print(r.line)
        return 0
    if not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 1
    out = C.run(spark, a.path, a.overwrite_all, a.fail_fast, a.stats_out, a.debug_joints, a.sentence_length_stats, a.clear_restart_log)
    if not a.quiet:
        print(json.dumps({k: v for k, v in out.items() if k != "file_stats"}, indent=2))
    return 1 if os.path.isfile(a.path) and out["files_failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
