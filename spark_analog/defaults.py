"""Fixed values that results depend on."""

from __future__ import annotations

# --- fixed values: label spellings -------------------------------------------------
NORMAL_TOKENS = ("normal", "benign", "false", "no", "n", "normaloperation", "noattack")
ATTACK_TOKENS = (
    "attack", "attacked", "anomaly", "anomalous", "abnormal", "malicious", "true", "yes", "y",
)

# --- fixed values: names of time-like columns ---------------------------------------
TIME_COLUMNS = ("time", "timestamp", "timestampmin", "datetime", "date", "index", "unnamed0")
LABEL_COLUMNS = (
    "normalattack", "attacklabel", "attack", "anomalylabel", "anomaly", "label", "class",
    "status",
)

# --- fixed values: chronological splits ---------------------------------------------
FOUR_WAY = (0.70, 0.10, 0.10, 0.10)
BASE_VALIDATION_FRACTION = 0.15

# --- fixed values: score grids, in loop order ----------------------------------------
TOP_Q_GRID = (0.05, 0.1, 0.2, 0.4, 1.0)
MEMORY_GRID = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
AGREEMENT_GRID = (0.0, 0.1, 0.25, 0.5, 1.0, 2.0)
SMOOTHING_GRID = (1, 3, 5, 9)
TEMPERATURE_GRID = (0.05, 0.15, 0.50, 1.00)
FALLBACK_PARAMETERS = {
    "top_q": 0.2, "memory_weight": 0.25, "agreement_weight": 0.25, "smoothing": 1,
}

# --- fixed values: retrieval ----------------------------------------------------------
MEMORY_TEMPERATURE = 0.15
WAVEFORM_POINTS = 16
SCALE_FLOOR = 1e-6
POOL_FACTOR = 4
BOUNDARY_SHARE = 0.20

# --- fixed values: scoring ------------------------------------------------------------
MAD_CONSISTENCY = 1.4826
CDF_CLIP = 1e-5
TAIL_CAP = 12.0
DOUBLE_EPS = 2.220446049250313e-16
FLOAT32_MAX = 3.4028234663852886e38
INITIAL_GATE = 0.10
QUALITY_MARGIN = 0.10
QUALITY_TEMPERATURE = 0.05

# --- fixed values: published Nemenyi q at alpha = 0.05 (already divided by sqrt 2) ------
NEMENYI_Q05 = {
    2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164,
}

# --- fixed values: measurement grid and bank sizes in bytes -----------------------------
GRID_TOP_K = (1, 3, 5, 10)
GRID_MEMORY = (64, 128, 256, 512)
GRID_PAYLOAD_BYTES = {64: 202_800, 128: 401_200, 256: 798_000, 512: 1_591_600}
