"""The queries of this package and their SQL twins, by operator."""

from __future__ import annotations

import public_tokenizers

from rankflow.llm.common import read_table
from rankflow.llm.encoding import encode_decode
from rankflow.llm.exact_dedup import ORACLE_SQL as DEDUP_SQL
from rankflow.llm.exact_dedup import dedup_table
from rankflow.llm.html_text import extract
from rankflow.llm.lattice import score_texts
from rankflow.llm.near_dedup import near_duplicates
from rankflow.llm.packing import pack
from rankflow.llm.quality_rules import ORACLE_SQL as RULES_SQL
from rankflow.llm.quality_rules import judge
from rankflow.llm.repeats import find_repeats
from rankflow.llm.secrets import scan
from rankflow.llm.site_quality import classify


def op1_site_quality(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return dedup_table(spark, f"{sf_dir}/documents.parquet")


def op3_secrets(spark, sf_dir):
    return scan(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_lattice(spark, sf_dir):
    return score_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe(spark, sf_dir):
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests_only=True)


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), threshold=85)


def op7_repeats(spark, sf_dir):
    return find_repeats(read_table(spark, sf_dir, "documents"))


def op8_html(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))


def op9_host_rules(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": DEDUP_SQL, "op9_host_rules": RULES_SQL}
