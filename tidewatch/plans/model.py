"""Fixed values of the demonstration scorer and cohort: a logistic model over order level features."""

from tidewatch.operators.cleaning import LabelFlip, Shift

FEATURES = ["qty_mean", "qty_std", "price_mean", "disc_mean", "tax_mean", "n_lines", "total_price", "acct_bal"]
CENTER = dict(zip(FEATURES, [25.4, 13.4, 53000.0, 0.05, 0.04, 4.07, 250000.0, 4500.0]))
SCALE = dict(zip(FEATURES, [8.41, 5.3, 17393.0, 0.0167, 0.0137, 1.93, 143900.0, 3210.0]))
WEIGHT = dict(zip(FEATURES, [0.9, -0.4, 0.6, 0.3, -0.2, 0.7, 0.5, -0.3]))
INTERCEPT = 1.0

WINDOW_SIZE = 1000
WINDOW_STEP = 500

SHIFTS = [
    Shift("phase2", "total_price", multiply=0.9, noise_std=0.02, component="gradual_price"),
    Shift("phase2", "acct_bal", multiply=0.9, noise_std=0.02, component="gradual_price"),
    Shift("phase3", "total_price", multiply=0.72, noise_std=0.04, component="severe_price"),
    Shift("phase3", "qty_mean", multiply=1.275, noise_std=0.03, component="volume_upward"),
    Shift("phase3", "price_mean", multiply=1.275, noise_std=0.03, component="volume_upward"),
    Shift("phase3", "disc_mean", noise_std=0.015, component="correlation_break"),
]
FLIP = LabelFlip("phase3", 0.07)

READING_KINDS = ["click", "purchase", "error", "signup", "view"]
