"""spark-submit jobs/evolution.py --corpus PATH [--output_csv DIR] ..."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicflow.operators.alignment import assignment_log  # noqa: E402
from topicflow.plans.evolution import Config, report, run  # noqa: E402
from topicflow.session import get_session, ship_package  # noqa: E402
from topicflow.sources.corpus import read_corpus, strip_mail  # noqa: E402


def parse_args(argv=None) -> argparse.Namespace:
    d = Config()
    p = argparse.ArgumentParser(description="Topic evolution over an ordered corpus.")
    p.add_argument("--corpus", required=True, help="path of the corpus")
    p.add_argument("--format", default="parquet", help="any Spark source format")
    p.add_argument("--id_col", default="doc_id", help="'' for a corpus in file order without ids")
    p.add_argument("--text_col", default=None, help="text by default, value for the text format")
    p.add_argument("--order_by", default="", help="order column; the document id by default")
    p.add_argument("--strip_mail", nargs="*", choices=("headers", "footers", "quotes"), default=None,
                   help="remove these parts of mail; all of them if none is named")
    p.add_argument("--time_col", default=None, help="slice by windows of this time in place of n_slices runs")
    p.add_argument("--time_width", default=d.time_width, help="width of a time window, such as '30 days'")
    p.add_argument("--n_slices", type=int, default=d.n_slices)
    p.add_argument("--n_topics", type=int, default=d.n_topics)
    p.add_argument("--max_features", type=int, default=d.max_features)
    p.add_argument("--max_iter", type=int, default=d.max_iter)
    p.add_argument("--top_n", type=int, default=d.top_n, help="words per topic for coherence and diversity")
    p.add_argument("--random_state", type=int, default=d.random_state)
    p.add_argument("--output_csv", default=None, help="folder for the one-row CSV")
    return p.parse_args(argv)


def main(argv=None) -> None:
    a = parse_args(argv)
    spark = get_session("topic-evolution")
    ship_package(spark)
    order = [a.order_by] if a.order_by else []
    keep = order + ([a.time_col] if a.time_col else [])
    corpus = read_corpus(spark, a.corpus, a.format, a.id_col or None, a.text_col, keep)
    if a.strip_mail is not None:
        corpus = strip_mail(corpus, a.strip_mail or ("headers", "footers", "quotes"))
    cfg = Config(
        a.n_slices, a.n_topics, a.max_features, a.max_iter, a.random_state, a.top_n,
        order_cols=tuple(order) or ("doc_id",), time_col=a.time_col, time_width=a.time_width,
    )
    out = run(spark, corpus, cfg, a.output_csv)
    assignment_log(out.tracks).orderBy("slice_id").show(out.result.first()["n_slices"], truncate=False)
    report(out.result).show(truncate=False)
    out.close()


if __name__ == "__main__":
    main()
