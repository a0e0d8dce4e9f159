"""The queries of this subpackage and the SQL of those that SQL can express."""

from seekspark.llm import ann, html_text, kd_sharding, langid, line_dedup, minhash, mpeg_audio, packing, sentencepiece_viterbi, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_sentencepiece": sentencepiece_viterbi.op2,
    "op3_toxicity": toxicity.op3,
    "op4_kd_sharding": kd_sharding.op4,
    "op5_minhash": minhash.op5,
    "op6_language_id": langid.op6,
    "op7_html_extraction": html_text.op7,
    "op8_mpeg_audio": mpeg_audio.op8,
    "op9_packing": packing.op9,
    "op10_ann": ann.op10,
}

ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE_SQL}
