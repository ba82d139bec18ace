"""The queries of this subpackage, with their SQL where there is one."""

from __future__ import annotations

from . import crf_quality, decision_list, feistel_shards, length_histogram, line_dedup, minhash, mixing, mpeg_audio, packing, suffix_dedup


def queries() -> dict:
    return {
        "op1_curve_packing": packing.op1_curve_packing,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_minhash": minhash.op4_minhash,
        "op5_crf_quality": crf_quality.op5_crf_quality,
        "op6_mpeg_audio": mpeg_audio.op6_mpeg_audio,
        "op7_quality_rules": decision_list.op7_quality_rules,
        "op8_length_histogram": length_histogram.op8_length_histogram,
        "op9_feistel_shards": feistel_shards.op9_feistel_shards,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
    }
