"""One query per operator, and their SQL where SQL can express them."""

import corpus_pipeline
from sparklode.llm.bpe_transducer import op3_bpe_transducer
from sparklode.llm.decontaminate import op8_decontaminate
from sparklode.llm.license_scan import OP2_SQL, op2_license_scan
from sparklode.llm.merkle import OP11_SQL, op11_merkle_manifest
from sparklode.llm.minmax import OP13_SQL, op13_minmax_dedup
from sparklode.llm.parity_join import OP10_SQL, op10_parity_join
from sparklode.llm.quality_rules import OP6_SQL, op6_quality_rules
from sparklode.llm.quality_net import op7_quality_net
from sparklode.llm.repeats import op4_suffix_dedup
from sparklode.llm.sharding import op1_kd_shards
from sparklode.llm.squares import OP12_SQL, op12_periodic_runs
from sparklode.llm.token_counts import op5_token_counts
from sparklode.llm.url_rules import OP9_SQL, op9_url_rules

QUERIES = {f.__name__: f for f in (
    op1_kd_shards, op2_license_scan, op3_bpe_transducer, op4_suffix_dedup,
    op5_token_counts, op6_quality_rules, op7_quality_net, op8_decontaminate,
    op9_url_rules, op10_parity_join, op11_merkle_manifest,
    op12_periodic_runs, op13_minmax_dedup)} | {"pipeline": corpus_pipeline.run}

ORACLE = {"op2_license_scan": OP2_SQL, "op6_quality_rules": OP6_SQL,
          "op9_url_rules": OP9_SQL, "op10_parity_join": OP10_SQL,
          "op11_merkle_manifest": OP11_SQL, "op12_periodic_runs": OP12_SQL,
          "op13_minmax_dedup": OP13_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
