"""Default parameters. Every operator takes its own as arguments."""

# Thresholds, list lengths, seeds, model settings and file fields that the results depend on.

# Neighbourhood models
MIN_CO_RATED = 3
MIN_JACCARD_USERS = 0.01
MIN_JACCARD_ITEMS = 0.05
ITEM_NEIGHBOURS = 7
USER_NEIGHBOURS = 100

# MinHash
NUM_HASHES = 50
HASH_SEED = 10000
SEARCH_RECALL = 0.9

# Word profiles
PROFILE_WORDS = 200
RARE_SHARE = 1e-6
MIN_LENGTH = 2
MIN_COSINE = 0.01

# Content recommendations
LIKED_FROM = 3.0
SEED_SHARE = 0.5
MAX_SEEDS = 5
SIMILAR_PER_SEED = 15

# Text features
TOKEN_PATTERN = r"(?U)\w+"  # with accents; without (?U) the JVM knows ASCII letters only
WORD_PARTITIONS = 8
VECTOR_SIZE = 100
MIN_COUNT = 5

# Matrix factorisation: the tuned model, and the grid it was chosen from
LEARNING_SEED = 123
TEST_SHARE = 0.2
RANK = 20
ITERATIONS = 20
REGULARISATION = 0.3
GRID = (10, 15, 20)
FOLDS = 5
BLOCKS = 10
TOP = 10

# Hybrid list
CONTENT_MAX = 4
COLLABORATIVE_MAX = 4

# Fields of the JSON-lines files
REVIEW = "user_id string, business_id string, stars double, text string"
PAIR = "user_id string, business_id string"
BUSINESS = (
    "business_id string, business_name string, categories string, stars double, "
    "review_count int, latitude double, longitude double"
)
USER = "user_id string, name string, friends array<string>"
ITEM_MODEL = "b1 string, b2 string, sim double"
USER_MODEL = "u1 string, u2 string, sim double"
PREDICTION = "user_id string, business_id string, stars double"
CONTENT_SCORE = "user_id string, business_id string, sim double"
