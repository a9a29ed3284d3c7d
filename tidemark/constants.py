"""Fixed values of the domain: codes, bands, thresholds and limits."""

# Quality codes: id, code, family, usable.  Usable means id >= 64.
QUALITY = (
    (192, "GOOD", "GOOD", True),
    (200, "GOOD_SUBSTITUTED", "GOOD", True),
    (64, "UNCERTAIN_RANGE", "UNCERTAIN", True),
    (65, "UNCERTAIN_STALE", "UNCERTAIN", True),
    (0, "BAD_MISSING", "BAD", False),
    (8, "BAD_RANGE", "BAD", False),
    (16, "BAD_DIGITAL", "BAD", False),
)
GOOD, STALE, MISSING, BAD_RANGE, BAD_DIGITAL = 192, 65, 0, 8, 16

# Operating states by motor current: below 1, below 5, below 8, the rest.
STATES = ("OFF", "OFFLOADED", "LOADED", "STARTING")
STATE_BANDS = (1.0, 5.0, 8.0)
BASELINE_STATES = ("OFF", "OFFLOADED", "LOADED")
BASELINE_MIN_SAMPLES = 500
IQR_FENCE = 1.5

ADAPTIVE_WINDOW, ADAPTIVE_MIN_HISTORY = 168, 24
ROBUST_Z_WARNING, ROBUST_Z_CRITICAL, MAD_SCALE = 3.5, 5.0, 0.6745
PERSISTENCE = 3
IQR_CRITICAL = 1.5
SETPOINT, SETPOINT_CRITICAL, SETPOINT_MIN_SCANS = 7.0, 6.0, 3
ALARMS_TARGET, ALARMS_MAX = 150, 300

GAP_SECONDS, SCAN_SECONDS, FLATLINE_SAMPLES, DIVERGENCE = 30, 10, 6, 0.5
DETAIL_CAP = 1000
SAMPLES_PER_HOUR, SAMPLES_PER_DAY = 360, 8640
RAW_MAX_HOURS, HOURLY_MAX_DAYS, MAX_POINTS, MAX_SENSORS, MAX_WINDOW_DAYS = 6, 30, 50_000, 8, 400
READINGS_DEFAULT_DAYS, TREND_DEFAULT_DAYS, ACTIVE_HOURS = 7, 30, 24
COMPRESSION_PCT, COMPRESSION_SWEEP = 0.1, (0.02, 0.05, 0.1, 0.25, 0.5, 1.0)
LEAD_UP_HOURS, MIN_USABLE_FRACTION = (24, 12, 6, 1), 0.5
HOLDOUT_DAYS, MA_DAYS = 21, 7
