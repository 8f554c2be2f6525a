"""Sources and sinks."""

from weftline.sources.memory import empty, from_rdd, from_rows, matching_relation
from weftline.sources.text import load_graph_edges, load_tsv, undirected, write_tsv

__all__ = ["empty", "from_rdd", "from_rows", "load_graph_edges", "load_tsv", "matching_relation", "undirected", "write_tsv"]
