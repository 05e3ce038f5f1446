"""Table schemas and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, D, I, B = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TURN_INPUT = struct(session_id=S, speaker=S, text=S, ts=L, uuid=S, scope=S)
TURN = struct(id=L, uuid=S, session_id=S, speaker=S, text=S, ts=L, created_at=L, kind=S, scope=S)
MENTION = struct(key=S, kind=S, surface=S, start=I, end=I)
MENTIONS = struct(turn_id=L, entity=S, kind=S, surface=S, start=I, end=I)
RELEVANCE = struct(uuid=S, grade=I)
LABELED_QUERY = struct(id=S, kind=S, query=S, latest_session_id=S, relevant=T.ArrayType(RELEVANCE), ask=S)
RANKED = struct(id=S, ranked=T.ArrayType(S))
ACTION_PAYLOAD = struct(
    turns=T.ArrayType(S), by=S, alias=S, canonical=S, entity=S, session_id=S, scope=S,
    note=S, brief=S, previous=S, sources=T.ArrayType(S), summary=S, cursor=L,
)
ACTION_LOG = struct(
    id=L, run_id=S, actor=S, ts=L, op=S, payload=ACTION_PAYLOAD, reason=S, undone_at=L, undone_by=S
)
EVAL_RUN = struct(
    recorded_at=S, commit=S, label=S, profile=S, embedder=S, k=I, queries=I, missed=I,
    recall_at_k=D, mrr=D, ndcg_at_k=D, tokens_per_answer=D, history_ndcg_at_k=D, as_of_ndcg_at_k=D,
    abstain_answered=D, abstain_withheld=D, abstain_auc=D,
)
QUERY_OPTIONS = struct(
    top_k=I, exclude_session=S, session=S, since=L, until=L, scope=S, include_hidden=B, context=I
)
MESSAGE = struct(role=S, content=S, has_answer=B)

MINUTE_MS = 60_000
DAY_MS = 86_400_000

# The numbers below decide results and have to stay as they are.
WINDOW_GAP_MS = 30 * MINUTE_MS
WINDOW_MAX_TURNS = 50
EPISODE_MIN_OVERLAP = 0.15
SEGMENT_ENTITIES = 8

DEFAULT_TOP_K, MAX_TOP_K = 5, 50
VIEW_LIMIT = 50
MAX_ENTITY_SHARE = 0.4
MAX_CONTEXT, MAX_CONTEXT_TURNS = 10, 40
SUPERSEDED_FACTOR = 0.5
COLLAPSE_PASSES = 5
ENTITY_NEIGHBOURS, NEIGHBOUR_WEIGHT = 5, 0.3
RRF_K = 10.0
HALF_LIFE_MS = 30.0 * DAY_MS
WINDOW_BOOST, HISTORY_BOOST = 0.1, 0.25
VIEW_WEIGHTS = {"lexical": 1.0, "entity": 0.5, "dense": 0.8, "recent": 0.2}
DENSE_FALLBACK_WEIGHT = 0.4
RECENCY_TEMPORAL, RECENCY_TIEBREAK = 0.3, 0.02
DROP_BELOW, PRIMARY_AT = 0.35, 0.7
MISS_PENALTY, ABSTAIN_BELOW, CLOSEST = 0.3, 0.5, 2
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6

FINDER_LIMIT, FINDER_MAX_LIMIT = 20, 100
SCAN_TURNS, SCAN_DUPLICATES = 5_000, 500
DUPLICATE_COSINE, DUPLICATE_PARTNERS = 0.95, 4
CONSOLIDATE_MIN_TURNS, CONSOLIDATE_MIN_AGE_MS = 8, 7 * DAY_MS
BRIEF_STALE_TURNS, BRIEF_SAMPLE_TURNS = 50, 5
CANDIDATE_CHARS, TARGET_CHARS, POINT_CHARS = 300, 240, 160
SUPERSEDE_MIN_OVERLAP, SUPERSEDE_EARLIER, SUPERSEDE_REACH = 0.3, 5, 30
ALIAS_NEIGHBOURS = 20

MIN_AGE_MS = DAY_MS
NOTE_MAX_CHARS, BRIEF_MAX_CHARS = 4_000, 1_500
SESSION_MAX_TURNS, SESSION_PAGE, SESSION_SIDE = 200, 50, 5
GRAPH_MAX_NODES, GRAPH_MAX_HOPS = 2_000, 3
HIERARCHY_MAX_SESSIONS = 500
PROJECTION_POINTS, PROJECTION_MAX_POINTS = 2_000, 10_000
HASH_DIM = 384
