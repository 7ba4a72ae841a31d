"""Operators for training data, each registered as a query over its whole table."""

import sys

from pyspark import cloudpickle

from . import ann, bpe, filter_audit, language, minhash, negatives, packing, preferences, secrets, spots, token_counts, urls, warc

# executors need not have this package on their path: functions of its tasks travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES = {
    q.__name__: q
    for q in (
        token_counts.op1_token_counts,
        language.op2_language,
        spots.op3_fingerprints,
        bpe.op4_bpe,
        packing.op5_packing,
        secrets.op6_secrets,
        urls.op7_urls,
        preferences.op8_preferences,
        ann.op9_neighbours,
        minhash.op10_near_dedup,
        warc.op11_archives,
        negatives.op12_negatives,
        filter_audit.op13_filter_audit,
    )
}

#: Operators that SQL can express over whole tables; the others are tested against brute force.
SQL = {
    "op7_urls": urls.OP7_SQL,
    "op8_preferences": preferences.OP8_SQL,
    "op11_archives": warc.OP11_SQL,
    "op12_negatives": negatives.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
