"""Values that results depend on."""

# fixed values: analysed muscles and co-contraction pairs
ANALYSED_MUSCLES = (
    "Brachioradialis",
    "Biceps Brachii Short Head",
    "Pectoralis Major",
    "Anterior Deltoid",
    "Middle Deltoid",
    "Posterior Deltoid",
    "Triceps Brachii Lateral Head",
    "Triceps Brachii Long Head",
    "Infraspinatus",
    "Latissimus Dorsi",
    "Biceps Brachii Long Head",
    "Trapezius Middle",
)
COCONTRACTION_PAIRS = (
    ("Biceps Brachii Long Head", "Triceps Brachii Long Head"),
    ("Biceps Brachii Short Head", "Triceps Brachii Lateral Head"),
    ("Anterior Deltoid", "Posterior Deltoid"),
)
# fixed values: rate when a recording states none, envelope band and smoothing in Hz, scale quantile
FALLBACK_HZ = 150.0
ENVELOPE_BAND = (20.0, 450.0)
SMOOTH_HZ = 6.0
SCALE_AT = 0.99
# fixed values: share of variance that every channel, or all together, must reach; gain below which more components stop
REACHED, GAIN = 0.90, 0.01
