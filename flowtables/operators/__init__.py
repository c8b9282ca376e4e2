"""DataFrame operators: skew-safe building blocks, lineage, graph, runs, replays, alerts, metrics."""
