"""Lists, codes, patterns and constants the results depend on."""

# Arrival airports, in the order that decides ties between them.
AIRPORTS = ["KDEN", "KMEM", "KORD", "KSEA", "KDFW", "KPHX", "KCLT", "KATL", "KMIA", "KJFK"]

# Time grid and cycle.
BUCKET_MINUTES = 15
CYCLE_START = "2022-09-01 00:00:00"
CYCLE_END_TARGET = "2023-09-01 20:00:00"
CYCLE_END_OBSERVED = "2023-09-01 23:00:00"
CYCLE_DAYS = 32
TRAIN_DAYS = 24
TRAIN_CYCLES = 10
OBSERVATION_TOLERANCE_HOURS = 6
BLOCK_HOURS = 4

# Cloud cover in eighths of the sky.
COVER_OKTAS = {"SKC": 0, "FEW": 2, "SCT": 4, "BKN": 7, "OVC": 8}
CLOUD_TYPES = ["CB", "TCU"]
CB_MULTIPLIER = 100
CLOUD_BAND_EDGES_FT = [0, 500, 2000, 10000, 20000, 35000]

# Units.
METRES_PER_STATUTE_MILE = 1609.344
VISIBILITY_CAP_MILES = 6
TENTHS_HPA_PER_TENTH_INCH = 33.8639

# Report layout.
BLOCK_START = r"(?=\d{4}/\d{2}/\d{2} \d{2}:\d{2})"
BLOCK_DATE = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2})"
AMENDMENT_WORD = "Ammendment"
AMENDMENT_CODE = "AMD"
CORRECTION_WORD = "Correction"
CORRECTION_CODE = "COR"

# Field patterns.
OBSERVATION_STATION = r"^([A-Z]{4})\b"
FORECAST_STATION = r"\b([A-Z]{4})\b"
REPORT_TIME = r"\b(\d{6})Z\b"
VALIDITY = r"\b(\d{4}/\d{4})\b"
FROM_TIME = r"\bFM(\d{6})\b"
TEMPO = r"TEMPO\s(\d{4}/\d{4}) "
BECMG = r"BECMG\s(\d{4}/\d{4}) "
CLOUD_LAYER = r"(CLR|FEW\d{3}[A-Z]*|SCT\d{3}[A-Z]*|BKN\d{3}[A-Z]*|OVC\d{3}[A-Z]*)"
METRES = r"\b(\d{4})\b"
MILES_LOOSE = r"(9999|\d{1,2}SM)"
TEMPERATURE_LOOSE = r"((?:\d{2}|M\d{2})/(?:\d{2}|M\d{2}))"
WIND = r"(\d{3})(\d{2})(?:G(\d{2}))?KT"
WIND_GUST_AFTER_UNIT = r"(\d{3})(\d{2})KT(?:G(\d{2}))?"
ALTIMETER_Q = r"Q(\d{4})"
ALTIMETER_INCHES = r"QNH(\d{4})INS"
ALTIMETER_HPA = r"QNH(\d{4})HPA"

# Stricter forms that read a field only where it stands as a word of its own.
METRES_WORD = r"(?:^|\s)(\d{4})(?:\s|$)"
MILES_UNLIMITED = r"(?:^|\s)(9999)(?:\s|$)"
MILES_WHOLE = r"(?:^|\s)[PM]?(\d{1,2})SM(?:\s|$)"
MILES_FRACTION = r"(?:^|\sM?)((?:\d{1,2} )?\d/\d{1,2})SM(?:\s|$)"
TEMPERATURE_WORD = r"(?:^|\s)(M?\d{2}/M?\d{2})(?:\s|$)"
TEMPERATURE_MOST = r"(?:^|\s)TX(M?\d{2})/\d{4}Z(?:\s|$)"
TEMPERATURE_LEAST = r"(?:^|\s)TN(M?\d{2})/\d{4}Z(?:\s|$)"
ALTIMETER_A = r"\bA(\d{4})\b"

# File names.
FLIGHT_FILE = r"^([^_]+)_(\d{4}-\d{2}-\d{2})\.(\w+)\.csv$"
TWO_DATES = r"\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2}"
FORECAST_FILE = r"^taf\.(\d{8})\.(\d{2})Z\.txt$"
POLYGON_FILE = r"(\d{4})_(\d{2})_(\d{2})_(\d{2})_(\d{2})_GMT"

# Scores.
SCORE_SCALE = 10.0

# The nineteen weather fields on the spine; the first three plus three per cloud band, plus one misspelt
# field that is always 0 when there is a report and is kept only for results that must carry it.
WEATHER_BASE = ["temperature", "visibility", "wind_speed"]
MISSPELT_BAND = "TCU_200_10000"
