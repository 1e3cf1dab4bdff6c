"""The registered queries of the corpus operators and, where SQL can express them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, credentials, fingerprints, language, packing, partenum, pii, sharding, suffixes, tiff, trie, urlfilter
from .common import documents, prepare

Plan = Callable[[SparkSession, str], DataFrame]


def _prepared(fn: Plan) -> Plan:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__doc__ = fn.__doc__
    return run


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, equal texts together."""
    return sharding.shard_documents(documents(spark, sf_dir))


QUERIES: dict[str, Plan] = {
    name: _prepared(fn)
    for name, fn in {
        "op1_merkle_fingerprints": fingerprints.op1,
        "op2_pair_index_bpe": bpe.op2,
        "op3_credential_links": credentials.op3,
        "op4_bucket_pointer_suffixes": suffixes.op4,
        "op5_mixture_packing": packing.op5,
        "op6_partenum_join": partenum.op6,
        "op7_pii_anchors": pii.op7,
        "op8_kneser_ney_language": language.op8,
        "op9_tiff_pages": tiff.op9,
        "op10_label_shards": op10,
        "op11_exact_text_alignment": alignment.op11,
        "op12_prefix_trie": trie.op12,
        "op13_url_logistic": urlfilter.op13,
    }.items()
}
ORACLES: dict[str, str] = {"op12_prefix_trie": trie.OP12_SQL}
