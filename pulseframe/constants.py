"""Thresholds, patterns and texts that define the results.

Everything here is part of the semantics (two systems only agree when these agree), so
the values stand together, in plain form.
"""

# --- de-identification --------------------------------------------------------------
JITTER_HOURS_MIN = -720
JITTER_HOURS_MAX = 720
PSEUDONYM_PREFIX = "PID-"
PSEUDONYM_HEX = 16
UNKNOWN_PATIENT = "UNKNOWN_PATIENT"

# (name, pattern, replacement), applied in this order
SCRUB_PATTERNS = [
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b", "[REDACTED_PHONE]"),
    ("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    (
        "name",
        r"(?i)\b(?:mr\.|mrs\.|ms\.|dr\.|patient|name|subject)[\s:]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b",
        "Patient [REDACTED_NAME]",
    ),
]
RAW_ARRAY_PATTERN = r"\[\s*-?\d+\.\d+(?:,\s*-?\d+\.\d+){4,}\s*\]"
RAW_ARRAY_TAG = "[RAW_SIGNAL_DATA_REDACTED]"

FORBIDDEN_KEYS = [
    "name", "patient_name", "first_name", "last_name", "ssn", "mrn", "phone", "email",
    "address", "zip", "postal_code", "ip_address", "device_serial", "physician", "doctor",
]
ID_KEY_EXCEPTIONS = ["channel_id", "lead_id"]
PATIENT_ID_KEYS = ["patient_id", "subject_id", "record_id"]

# --- signals ------------------------------------------------------------------------
ECG_FS = 360.0
PPG_FS = 125.0
ECG_BAND = (0.5, 45.0)
PPG_BAND = (0.5, 5.0)
NOTCH_HZ = 50.0
NOTCH_Q = 30.0
BANDPASS_ORDER = 4
CUTOFF_CLAMP = (0.0001, 0.9999)
BASELINE_SECONDS = 0.6
BASELINE_MAX_KERNEL = 101
PRIMARY_LEADS = ["MLII", "ECG"]

# --- signal quality -----------------------------------------------------------------
KURTOSIS_MIN = 2.0
KURTOSIS_MAX = 60.0
BASELINE_RATIO_MAX = 0.60
EMG_RATIO_MAX = 0.35
FLATLINE_VARIANCE = 1e-7
REASON_SHORT = "Window duration is too short (< 1 sec)."
REASON_FLAT = "Flatline or sensor disconnection detected."
REASON_LOW_KURTOSIS = "Low kurtosis: lacking distinct QRS complexes or excessive white noise."
REASON_HIGH_KURTOSIS = "Extreme kurtosis: high-amplitude impulse artifact / motion spike."
REASON_BASELINE = "Severe baseline wander (%.1f%% low-frequency power)."
REASON_EMG = "Severe muscle/EMG noise (%.1f%% high-frequency power)."
REASON_OK = "Acceptable signal quality"

# --- validation ---------------------------------------------------------------------
RANGE_RULES = {  # signal type -> (low, high, message format)
    "ECG": (-10.0, 10.0, "ECG voltage [%.2f, %.2f] mV exceeds plausible limits."),
    "SPO2": (50.0, 100.0, "SpO2 value [%.1f%%, %.1f%%] outside physiological range [50%%, 100%%]."),
    "HR": (30.0, 240.0, "Heart rate [%.1f, %.1f] bpm outside physiological range [30, 240] bpm."),
}
FS_TOLERANCE = 0.5
REQUEST_NO_PAYLOAD = "Payload must contain either 'signal' (array of floats) or 'features' (dict/array)."
REQUEST_SHORT = "Signal is too short (%d samples). Minimum is 100."
REQUEST_LONG = "Signal exceeds maximum allowed length (50000 samples)."
REQUEST_NOT_NUMERIC = "Signal elements must be numeric floating-point values."
REQUEST_INFINITE = "Signal contains invalid infinite (Inf) values."
REQUEST_ALL_NAN = "Signal consists entirely of NaN values."
REQUEST_AMPLITUDE = "Signal amplitude [%.2f, %.2f] mV exceeds physical ECG range."
REQUEST_FS_TYPE = "Sampling frequency 'fs' must be a numeric float."
REQUEST_FS = "Sampling frequency %s Hz is outside allowable medical device range [20, 2000] Hz."
REQUEST_FEATURE_TYPE = "Feature '%s' must be numeric."
REQUEST_FEATURE_FINITE = "Feature '%s' contains non-finite value."
REQUEST_LIST_TYPE = "Features list must contain only numeric floats."
REQUEST_LIST_FINITE = "Features vector contains NaN or infinite values."
REQUEST_PPG = "Invalid ppg_signal format or length."
REQUEST_SPO2_FORM = "Invalid spo2_signal format or length."
REQUEST_SPO2 = "SpO2 values outside physiological range [40%, 100%]."
REQUEST_REJECTED = "Signal rejected due to severe motion artifact or sensor detachment."
REQUEST_MIN_SAMPLES = 100
REQUEST_MAX_SAMPLES = 50000
REQUEST_FS_RANGE = (20.0, 2000.0)
REQUEST_MV_LIMIT = 10.0
REQUEST_SPO2_RANGE = (40.0, 100.0)

# --- features, in vector order ------------------------------------------------------
FEATURES_TIME = [
    "mean_rr_ms", "sdnn_ms", "rmssd_ms", "pnn50",
    "mean_hr_bpm", "min_hr_bpm", "max_hr_bpm", "hr_range_bpm",
]
FEATURES_FREQ = ["vlf_power", "lf_power", "hf_power", "lf_hf_ratio", "total_power"]
FEATURES_STAT = [
    "stat_mean", "stat_std", "stat_var", "stat_skewness",
    "stat_kurtosis", "stat_p2p_amp", "stat_zcr", "stat_sample_entropy",
]
FEATURES_OXI = ["spo2_mean", "spo2_min", "spo2_std", "spo2_desat_ratio", "ppg_perfusion_index"]
FEATURES = FEATURES_TIME + FEATURES_FREQ + FEATURES_STAT + FEATURES_OXI
TIME_DEFAULTS = [800.0, 0.0, 0.0, 0.0, 75.0, 75.0, 75.0, 0.0]
FREQ_DEFAULTS = [0.0, 0.0, 0.0, 1.0, 0.0]
OXI_DEFAULTS = [98.0, 98.0, 0.0, 0.0, 1.5]
RR_VALID_MS = (250.0, 2000.0)
NN_STEP_MS = 50.0
HRV_BANDS = [("vlf", 0.0033, 0.04), ("lf", 0.04, 0.15), ("hf", 0.15, 0.40)]
DESATURATION = 90.0

# --- triage -------------------------------------------------------------------------
TIER_CRITICAL = 0.70
TIER_MONITOR = 0.35
CLASS_LABELS = {0: "Normal Sinus Rhythm", 1: "Arrhythmia / Cardiac Abnormality"}
VITALS_LABELS = {0: "Normal Sinus Rhythm", 1: "Arrhythmia / Abnormal"}
ALERT_ACTIONS = {  # level -> (alarm on, action)
    "CRITICAL": (True, "Physician Alert Dispatch"),
    "MONITOR": (False, "Nursing Review"),
    "LEADS_OFF": (True, "Check Electrode Pads"),
    "NORMAL": (False, "Passive Monitoring"),
}
TELEMETRY_DEFAULTS = {
    "device_id": "ESP32_UNKNOWN", "leads_off": False, "bpm": 72.0,
    "spo2": 98.0, "temperature_c": 36.5, "fs": 125.0,
}
LEADS_OFF_STATUS = "ALERT_LEADS_OFF"
LEADS_OFF_LABEL = "Leads Disconnected"
LATEST_SAMPLES = 150

# --- model --------------------------------------------------------------------------
SEED = 42
N_FOLDS = 5
TEST_SIZE = 0.20
VAL_SIZE = 0.15
CV_PARAMS = {"stepSize": 0.08, "maxIter": 120, "maxDepth": 5}
FINAL_PARAMS = {"stepSize": 0.08, "maxIter": 150, "maxDepth": 5}
SEARCH_GRID = [
    {"stepSize": 0.05, "maxIter": 100, "maxDepth": 4},
    {"stepSize": 0.08, "maxIter": 120, "maxDepth": 5},
    {"stepSize": 0.10, "maxIter": 150, "maxDepth": 6},
]
CALIBRATION_FOLDS = 3
CALIBRATION_MIN_ROWS = 50
DISPARATE_IMPACT_MIN = 0.80
TPR_SPREAD_MAX = 0.15
