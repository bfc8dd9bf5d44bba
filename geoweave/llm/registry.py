"""What __spark_entry__.py registers of this subpackage."""

import corpus_pipeline
from geoweave.llm import oracles, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op") and callable(f)}
ORACLES = {name: getattr(oracles, key) for name in QUERIES if hasattr(oracles, key := name.split("_")[0].upper())}

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
