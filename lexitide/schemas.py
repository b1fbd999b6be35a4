"""Explicit schemas of the tables that stages exchange."""

TWEET = "id string, full_text string, text string"
SENTENCE_TOKENS = "timestep string, doc_id string, sentence_id int, tokens array<string>"
COUNTS = "word string, timestep string, step_idx int, count bigint"
OCCURRENCES = "year int, tweet_id bigint, word string"
TAG_COUNTS = "word string, pos_counts array<struct<tag: string, n: bigint>>"
SAMPLED_IDS = "word string, year int, tweet_id bigint, sentence_id int"
CONTEXTS = "word string, position array<int>, doc_id string, sentence_id int, sentence string"
STATIC_VECTORS = "split string, word string, idx int, count bigint, vector array<float>"
CONTEXT_VECTORS = "split string, word string, vector array<float>"
ZSCORED_VECTORS = "split string, word string, vector array<double>"
PAIRS = "neologism string, control string"
SUMMARY = "is_neologism int, min_cos double, mean double, sem double"
