"""Parameters of the pipeline. Results depend on them."""

HOLDOUT = 0.15
BM25_K1, BM25_B, MIN_DF = 1.5, 0.75, 2
W2V_DIM, W2V_WINDOW, W2V_MIN_COUNT, W2V_EPOCHS, SEED = 128, 8, 2, 10, 42
RECALL_AT = (50, 100, 200)
HISTORY_WINDOW, RANK_DECAY, HALF_LIFE_HOURS = 50, 0.9, 72.0
SESSION_GAP_MINUTES = 30
POOL_SIZE = 100
COLD_UP_TO, HEAD_SHARE = 5, 0.2
TREES, RATE, DEPTH = 300, 0.08, 6
#: Queries of an exact search that are held at once.
QUERY_BLOCK = 4096
#: Clusters of a clustered search and how many are searched first; fewer where the table has fewer than 40 rows a cluster.
CLUSTERS, PROBES = 256, 16
PATIENCE, ROUNDS = 10, 1000
