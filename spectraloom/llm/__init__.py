"""Training-data operators: one module each, and ``queries`` / ``oracle_sql`` for the driver."""

from importlib import import_module

#: Query and the module of this package that has it; a module's SQL is its oracle, where SQL can tell.
MODULES = {
    "op1_suffixes": "suffixes",
    "op2_toxicity": "toxicity",
    "op3_audio": "audio",
    "op4_html": "html",
    "op5_minhash": "minhash",
    "op6_fingerprints": "sampling",
    "op7_sentencepiece": "pieces",
    "op8_secrets": "secrets",
    "op9_chaining": "chaining",
    "op10_mixing": "mixing",
    "op11_audit": "audit",
    "op12_urls": "urls",
    "op13_merkle": "merkle",
}


def queries():
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql():
    found = {name: getattr(import_module(f"{__name__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
