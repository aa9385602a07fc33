"""Constants that are part of the analyses' meaning."""

# Signals, their smallest meaningful changes and fit floors, change types.
MIN_EFFECT = {"NDVI": 0.05, "NDWI": 0.05, "NBR": 0.05, "VV": 1.0, "VH": 1.0, "RATIO": 1.0}
RMSE_FLOOR = {"NDVI": 0.02, "NDWI": 0.02, "NBR": 0.02, "VV": 0.3, "VH": 0.3, "RATIO": 0.3}
# change type: optical signal, expected sign, radar signal, its sign
CHANGES = {
    "clearing": ("NDVI", -1, "VH", -1),
    "regrowth": ("NDVI", 1, "VH", 1),
    "flood": ("NDWI", 1, "VV", -1),
    "burn": ("NBR", -1, "VH", -1),
    "construction": ("NDVI", -1, "VV", 1),
    "other": ("NDVI", 0, "VV", 0),
}
WORDS = {"NDVI": "greenness (NDVI)", "NDWI": "surface water index (NDWI)", "NBR": "burn ratio (NBR)", "VV": "radar backscatter (VV)", "VH": "radar backscatter (VH)", "RATIO": "radar cross-ratio (VH/VV)"}

# Thresholds of the land analysis.
BIN_DAYS, PRE_YEARS, MAX_POST_MONTHS = 10, 3, 18
DONORS_FULL, DONORS_LIVE, MIN_POOL, ELEVATION_M, COVERAGE = 80, 40, 30, 150.0, 0.70
ALPHA, PLACEBO_P, MIN_DONORS, MIN_PRE, MIN_POST = 0.10, 0.10, 20, 20, 3
CLEAR_FRACTION, LAMBDAS = 0.80, (0.0, 0.03, 0.1, 0.3, 1.0, 3.0)

# Thresholds of the air analysis.
AIR = {"min_effect": 1.0, "alpha": 0.10, "placebo_p": 0.10, "min_donors": 12, "min_placebos": 19, "min_pre": 52, "min_post": 8, "donor_k": 24, "coverage": 0.80, "cohort": 0.80, "lead_weeks": 13, "min_hours": 19, "min_days": 4}

# Thresholds of the field audit.
AUDIT = {"p": 0.05, "effect": 0.03, "rmse": 0.06, "coverage": 0.40, "collapse": -0.15, "decline": -0.05, "no_till": -0.12, "green": 0.06, "texture": 0.08}
RATE_LOW, RATE_CENTRAL, RATE_HIGH, EFFECT_REFERENCE = 0.2, 1.0, 2.0, 0.20
EARTH_M = 6_371_000.0
