"""Label system, column names and the fixed values every operator shares."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the task definition; do not reorder).
# The token-classification label set in code-point order; "O" sorts last.
LABELS = (
    "B-EMAIL",
    "B-ID_NUM",
    "B-NAME_STUDENT",
    "B-PHONE_NUM",
    "B-STREET_ADDRESS",
    "B-URL_PERSONAL",
    "B-USERNAME",
    "I-ID_NUM",
    "I-NAME_STUDENT",
    "I-PHONE_NUM",
    "I-STREET_ADDRESS",
    "I-URL_PERSONAL",
    "O",
)
# Labels a rule detector supplies; model output for them is dropped when rules run.
RULE_LABELS = ("B-EMAIL", "B-PHONE_NUM", "I-PHONE_NUM")
# Decision-threshold grid of the calibration sweep (step 0.25).
THRESHOLDS = (0.0, 0.25, 0.5, 0.75)
# F-beta weight of the task metric.
BETA = 5.0
# Quality gate: a run is bad when the best F5 falls below this.
F5_GATE = 0.925
# Length limits: pieces kept for training / testing, words kept by the left cut.
TRAIN_MAX_PIECES = 1750
TEST_MAX_PIECES = 3750
TRUNCATE_LEFT_WORDS = 1750
# Default split parameters (outer test fold, inner validation fold, eval fold).
OUTER_FOLDS, OUTER_FOLD, OUTER_SEED = 10, 9, 77
INNER_FOLDS, INNER_FOLD, INNER_SEED = 10, 5, 42
EVAL_FOLDS, EVAL_FOLD, EVAL_SEED = 5, 2, 42
# Focal loss configuration: gamma, and alpha of the "O" class (others 1).
FOCAL_GAMMA = 3.0
FOCAL_ALPHA_O = 0.02


class RewriteMode:
    """How decoded word labels are repaired into valid BIO sequences."""

    NO_REWRITE = 0
    REWRITE_STARTING_I = 1
    REWRITE_BOTH = 2

    ALL = (NO_REWRITE, REWRITE_STARTING_I, REWRITE_BOTH)


# ---------------------------------------------------------------------------

O_LABEL = "O"
O_ID = LABELS.index(O_LABEL)
NUM_LABELS = len(LABELS)
# The "target" labels: every non-O label.
TARGET_LABELS = tuple(label for label in LABELS if label != O_LABEL)
LABEL_TO_ID = {label: i for i, label in enumerate(LABELS)}

# Probability / logit column names of the wide score layout (one column per label id).
PROB_COLS = tuple(f"p{i}" for i in range(NUM_LABELS))
LOGIT_COLS = tuple(f"z{i}" for i in range(NUM_LABELS))
