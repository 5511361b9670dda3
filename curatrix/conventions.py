"""Fixed values shared by every operator.

These are the constants that results depend on; they are stated here once.
"""

# Split and class names, in keep priority order for splits.
SPLITS = ("Train", "Validation", "Test")
CLASSES = ("Fake", "Real")
KEEP_PRIORITY = ("Test", "Validation", "Train")

# File extensions accepted by the scanner.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff")

# Audit thresholds.
MIN_SIDE = 64
ASPECT_TOLERANCE = 0.05
BLUR_THRESHOLD = 50.0
BLANK_THRESHOLD = 1.0
DARK_THRESHOLD = 30.0
BRIGHT_THRESHOLD = 225.0
NEAR_DUP_DISTANCE = 5

# Label audit.
AMBIGUOUS_BAND = (0.35, 0.65)
MISLABEL_CONFIDENCE = 0.9
DEFAULT_THRESHOLD = 0.52
DIFFICULTY_TIERS = (0.52, 0.65, 0.80)

# Channel mean and standard deviation for feature vectors (RGB).
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Scores travel as whole millionths so that threshold tests are exact.
MICRO = 1_000_000
