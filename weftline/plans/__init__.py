"""Planning above Catalyst: join hypergraphs, elimination orders, hypercube shuffles, materialisation."""
