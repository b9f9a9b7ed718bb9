"""Registered queries of this subpackage, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from tavolo.llm import audit, bpe, codes, lines, minhash, packing, pii, quality, rules, suffix, topk, urls, wrapper
from tavolo.sources import Tables

ROOT = str(Path(__file__).resolve().parents[2])
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            # Python workers find the package where the driver found it
            spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


@query("op1_bpe_encoding")
def op1(spark, sf_dir):
    return bpe.encode_digests(Tables(spark, sf_dir).documents, vocabulary())


@query("op2_minhash_near_dedup", minhash.oracle())
def op2(spark, sf_dir):
    return minhash.near_duplicates(Tables(spark, sf_dir).documents)


@query("op3_pii_spans")
def op3(spark, sf_dir):
    return pii.span_digests(Tables(spark, sf_dir).documents)


@query("op4_exact_topk", topk.oracle())
def op4(spark, sf_dir):
    return topk.top_inner_products(Tables(spark, sf_dir).embeddings)


@query("op5_line_dedup", lines.ORACLE)
def op5(spark, sf_dir):
    cut = lines.cut_lines(Tables(spark, sf_dir).documents)
    return cut.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_cut").alias("n_removed"),
                      F.sha2("text", 256).alias("text_sha256"))


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.score_documents(t.documents, quality.train(t.documents, t.labels))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return rules.quality_rules(Tables(spark, sf_dir).documents)


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    return suffix.remove_repeats(Tables(spark, sf_dir).documents)


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    return packing.pack_documents(Tables(spark, sf_dir).documents, vocabulary())


@query("op10_url_filters", urls.oracle())
def op10(spark, sf_dir):
    return urls.judge_urls(Tables(spark, sf_dir).pages)


@query("op11_vector_codes", codes.oracle())
def op11(spark, sf_dir):
    return codes.compress(Tables(spark, sf_dir).embeddings)


@query("op12_filter_audit", audit.oracle())
def op12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return audit.audit_filters(t.documents, t.labels)


@query("op13_html_extraction", wrapper.oracle())
def op13(spark, sf_dir):
    return wrapper.main_text(Tables(spark, sf_dir).pages)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
