"""Small graphs, 1-based as in their files."""

#: Two blocks joined by a bridge.
BRIDGE = [(2, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 4), (6, 5), (7, 5), (7, 6)]
TWO_CLIQUES = [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 3), (6, 5), (7, 5), (7, 6), (8, 5), (8, 6), (8, 7)]
PATH = [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
#: Diagonal entries, and pairs given one way or both.
MESSY = [(1, 1), (1, 5), (1, 6), (2, 2), (3, 3), (3, 4), (3, 6), (4, 2), (4, 4), (4, 6), (5, 1), (5, 2), (6, 1), (6, 3)]
KMERS = [(1, 2), (1, 3), (1, 5), (2, 2), (3, 4), (4, 2), (4, 3), (4, 5)]


def edges(spark, pairs):
    """(u, v), 0-based, u < v."""
    rows = sorted({(min(a, b) - 1, max(a, b) - 1) for a, b in pairs if a != b})
    return spark.createDataFrame(rows, "u long, v long")


def entries(spark, pairs):
    return spark.createDataFrame([(a - 1, b - 1) for a, b in pairs], "row long, col long")


def mtx_text(pairs, rows, cols):
    return f"%%MatrixMarket matrix coordinate pattern\n% a comment\n{rows} {cols} {len(pairs)}\n" + "\n".join(f"{a} {b}" for a, b in pairs)
