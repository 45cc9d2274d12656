"""Structure tour of every repository in a chunk table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparklode import model as M
from sparklode.functions import paths
from sparklode.functions.storage import graph_facts
from sparklode.operators import graph
from sparklode.operators.evidence import tour_evidence


@dataclass
class Tour:
    counts: DataFrame
    top: DataFrame
    entries: DataFrame
    selected: DataFrame
    evidence: DataFrame


def tour(chunks: DataFrame, path_prefix: str | None = None,
         n_top: int = M.TOP_FUNCTIONS, cap: int = M.TOUR_CHUNKS) -> Tour:
    if path_prefix:
        chunks = chunks.where(paths.under_prefix(chunks["file_rel_path"], path_prefix))
    facts = graph_facts(chunks)
    counts = graph.inbound_counts(graph.call_edges(facts))
    top = graph.resolve_files(graph.top_functions(counts, n_top), facts)
    entries = graph.entry_points(facts, counts)
    selected = graph.select_representatives(
        graph.structural_score(facts, counts), entries, cap)
    return Tour(counts, top, entries, selected,
                tour_evidence(selected, top, chunks, path_prefix or "full repo"))
