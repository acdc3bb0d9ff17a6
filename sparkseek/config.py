"""Configuration blocks: the keys each block takes and what their values are. Fixed values of the language."""

from __future__ import annotations

from typing import Any

from sparkseek.errors import fail

COUNT, FLAG, REAL, WORD, WORDS = "a non-negative integer", "a boolean", "a number", "a string", "a list of strings"

BLOCKS: dict[str, dict[str, str]] = {
    "HNSW": {"m": COUNT, "ef_construct": COUNT, "full_scan_threshold": COUNT, "max_indexing_threads": COUNT, "on_disk": FLAG, "payload_m": COUNT, "inline_storage": FLAG},
    "VECTOR": {"on_disk": FLAG},
    "OPTIMIZERS": {"deleted_threshold": REAL, "vacuum_min_vector_number": COUNT, "default_segment_number": COUNT, "max_segment_size": COUNT, "memmap_threshold": COUNT, "indexing_threshold": COUNT, "flush_interval_sec": COUNT, "max_optimization_threads": COUNT, "prevent_unoptimized": FLAG},
    "PARAMS": {"replication_factor": COUNT, "write_consistency_factor": COUNT, "read_fan_out_factor": COUNT, "read_fan_out_delay_ms": COUNT, "on_disk_payload": FLAG, "shard_number": COUNT, "sharding_method": WORD, "shard_keys": WORDS},
    "QUANTIZATION": {"type": WORD, "disabled": FLAG, "always_ram": FLAG, "quantile": REAL, "bits": REAL, "compression": WORD, "encoding": WORD, "query_encoding": WORD},
    "SPARSE": {"modifier": WORD, "full_scan_threshold": COUNT, "on_disk": FLAG, "datatype": WORD},
    "MULTIVECTOR": {"comparator": WORD},
    "INDEX": {"is_tenant": FLAG, "on_disk": FLAG, "enable_hnsw": FLAG, "lowercase": FLAG, "ascii_folding": FLAG, "phrase_matching": FLAG, "lookup": FLAG, "range": FLAG, "is_principal": FLAG, "min_token_len": COUNT, "max_token_len": COUNT, "tokenizer": WORD, "stemmer": WORD, "stopwords": WORDS},
}
ALTER_ONLY = {"read_fan_out_factor", "read_fan_out_delay_ms"}
CHOICES = {("QUANTIZATION", "type"): ("scalar", "binary", "product", "turbo"), ("PARAMS", "sharding_method"): ("auto", "custom"), ("MULTIVECTOR", "comparator"): ("max_sim",), ("SPARSE", "modifier"): ("idf", "none")}
FIELD_TYPES = ("keyword", "integer", "float", "geo", "text", "bool", "datetime", "uuid")


def _fits(what: str, value: Any) -> bool:
    if what == FLAG:
        return isinstance(value, bool)
    if what == COUNT:
        return isinstance(value, int) and not isinstance(value, bool) and value >= 0
    if what == REAL:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, str) if what == WORD else isinstance(value, tuple) and all(isinstance(v, str) for v in value)


def check_block(block: str, entries: tuple[tuple[str, Any], ...], alter: bool = False) -> tuple[tuple[str, Any], ...]:
    """The entries with lower-case keys; raises if a key or value isn't one of the block's."""
    out = []
    for key, value in entries:
        name = key.lower()
        what = BLOCKS[block].get(name)
        if what is None or (name in ALTER_ONLY or block == "QUANTIZATION" and name == "disabled") and not alter:
            fail("VALIDATION-CONFIG", f"{block} takes no {key}")
        if not _fits(what, value):
            fail("VALIDATION-CONFIG", f"{key} is {what}")
        choices = CHOICES.get((block, name))
        if choices and value.lower() not in choices:
            fail("VALIDATION-CONFIG", f"{key} is one of {', '.join(choices)}")
        if name == "quantile" and not 0 < value <= 1:
            fail("VALIDATION-CONFIG", "quantile is in (0, 1]")
        out.append((name, value))
    if block == "QUANTIZATION" and not {"type", "disabled"} & {k for k, _ in out}:
        fail("VALIDATION-CONFIG", "QUANTIZATION needs a type")
    return tuple(out)
