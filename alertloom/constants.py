"""Fixed values of the advisory domain.

Everything in this file is a fixed value: word lists, lookup tables, limits
and format strings that results depend on. They are data, not logic.
"""

# --- fixed values: severities, statuses, windows ---------------------------
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "unknown": 4}
ACTIVE_STATUSES = ["active", "pending"]
NEARBY_STATUSES = ["active", "pending", "approved"]
HIDDEN_STATUSES = ["rejected", "invalid"]
SKEW_MINUTES = 15
WINDOW_DAYS = 7
LIMITS = {"active": 50, "history": 100, "map": 500, "nearby": 50}  # page sizes where none is given
DESCRIPTION_CHARS = 2000  # of a bulletin's text shown as its description
UNHEALTHY_AFTER = 3

# --- fixed values: geography -----------------------------------------------
COUNTRY_BOX = (23.0, 38.0, 60.0, 78.5)  # lat min, lat max, lng min, lng max
REGION_BOX = (20.0, 42.0, 55.0, 85.0)
GAZETTEER_BOX = (22.0, 38.8, 60.0, 78.8)
EARTH_RADIUS_KM = 6371.0088
PKT_ZONE = "Asia/Karachi"
DEFAULT_LOCATION = {
    "lat": 30.3753,
    "lng": 69.3451,
    "city": "Pakistan Centre",
    "country": "Pakistan",
    "country_code": "PK",
}
CLUSTER_RADIUS_PX = 45
CLUSTER_MAX_ZOOM = 10
CLUSTER_CLASSES = (5, 15)

# --- fixed values: hazard and severity words, tested in this order ----------
HAZARD_WORDS = [
    ("flood", ["flood", "inundation"]),
    ("flash_flood", ["flash flood", "flash-flood", "flashflood"]),
    ("heavy_rain", ["heavy rain", "heavyfalls", "heavy fall", "downpour"]),
    ("thunderstorm", ["thunderstorm", "thundershower", "lightning", "storm"]),
    ("cyclone", ["cyclone", "hurricane", "typhoon", "tropical storm"]),
    ("heatwave", ["heatwave", "heat wave", "extreme heat"]),
    ("earthquake", ["earthquake", "seismic", "quake"]),
    ("landslide", ["landslide", "land-slide", "mudslide"]),
]
SEVERITY_WORDS = [
    ("low", ["minor", "advisory", "be aware", "slight"]),
    ("medium", ["moderate", "warning", "be prepared", "significant"]),
    ("high", ["severe", "high risk", "major", "danger"]),
    ("critical", ["extreme", "emergency", "evacuate", "catastrophic"]),
]
GENERIC_HAZARDS = ["met", "weather", "unknown", ""]
HAZARD_VOCABULARY = [
    "flood", "flash_flood", "heavy_rain", "thunderstorm", "cyclone",
    "heatwave", "earthquake", "landslide", "general_advisory",
]

# --- fixed values: the four configured feeds --------------------------------
SOURCE_ROWS = [
    (1, "PMD Weather", "XML/HTML", "https://www.pmd.gov.pk/en/latest-weather-alerts.php", 2),
    (2, "PMD Earthquake", "HTML", "https://seismic.pmd.gov.pk/events.php", 1),
    (3, "NDMA Advisories", "HTML/PDF", "https://www.ndma.gov.pk/advisories", 3),
    (4, "FFD Bulletins", "HTML/PDF", "https://ffd.pmd.gov.pk/bulletin/A", 5),
]
SOURCE_COLUMNS = "id int, name string, source_type string, scrape_url string, polling_interval_minutes int"

# --- fixed values: entity types, in id order (ids start at 1) ---------------
ENTITY_TYPES = [
    "COUNTRY", "PROVINCE", "TERRITORY", "DIVISION", "DISTRICT", "TEHSIL",
    "CITY", "TOWN", "VILLAGE", "LOCALITY", "REGION", "RIVER", "DAM",
    "BARRAGE", "COASTAL_AREA", "ISSUING_OFFICE", "GOVERNMENT_AGENCY",
    "WEATHER_OFFICE", "UNKNOWN",
]
IGNORED_TYPES = ["COUNTRY", "ISSUING_OFFICE", "GOVERNMENT_AGENCY", "WEATHER_OFFICE"]
COLLECTION_OF_TYPE = {
    "CITY": "cities", "TOWN": "cities", "VILLAGE": "cities", "LOCALITY": "cities",
    "TEHSIL": "tehsils", "DISTRICT": "districts", "DIVISION": "divisions",
    "PROVINCE": "provinces", "TERRITORY": "provinces",
    "REGION": "geographic_features", "RIVER": "geographic_features",
    "DAM": "geographic_features", "BARRAGE": "geographic_features",
    "COASTAL_AREA": "geographic_features",
}
TYPE_PRIORITY = {
    "GOVERNMENT_AGENCY": 100, "ISSUING_OFFICE": 99, "WEATHER_OFFICE": 98,
    "COUNTRY": 97, "CITY": 90, "TOWN": 85, "TEHSIL": 80, "DISTRICT": 75,
    "PROVINCE": 70, "TERRITORY": 70, "VILLAGE": 50, "LOCALITY": 45,
    "RIVER": 40, "DAM": 40, "BARRAGE": 40, "REGION": 30, "COASTAL_AREA": 30,
    "DIVISION": 20, "UNKNOWN": 0,
}
GROUP_ORDER = [
    "PROVINCE", "TERRITORY", "DISTRICT", "TEHSIL", "CITY", "TOWN", "VILLAGE",
    "LOCALITY", "REGION", "RIVER", "DAM", "BARRAGE", "COASTAL_AREA",
]
POPULATED_TYPES = ["CITY", "TOWN", "VILLAGE", "LOCALITY"]
EVIDENCE = {
    "STRUCTURED_SCRAPER_FIELD": 100, "TITLE": 80, "DESCRIPTION": 60,
    "SAFETY_INSTRUCTIONS": 40, "RAW_TEXT": 20, "RIVER_MAPPING": 50,
}
SHORT_PATTERNS = [
    "kp", "gb", "pb", "pmd", "ndma", "ffd", "isb", "lhr", "khi", "kpk", "ict", "ajk",
]
EXTRACTION_VERSION = "typed-aho-2"
GAZETTEER_VERSION = "geonames-pk-2026.07+curated-3"
NAME_EXPANSIONS = {
    "distt": "district",
    "dist": "district",
    "d g khan": "dera ghazi khan",
    "d i khan": "dera ismail khan",
}
CURATED_ALIASES = {
    "Lahore": ["LHR"],
    "Karachi": ["KHI"],
    "Islamabad": ["ISB"],
    "Rawalpindi": ["Pindi"],
    "Pattoki": ["Patoki", "Pattoki City"],
    "Dera Ghazi Khan": ["DG Khan", "D.G. Khan"],
    "Dera Ismail Khan": ["DI Khan", "D.I. Khan"],
}
ADM1_NAMES = {
    "Punjab Province": "Punjab",
    "Sindh Province": "Sindh",
    "Islamabad": "Islamabad Capital Territory",
}

# --- fixed values: gauging stations and rivers to districts -----------------
STATION_DISTRICT = {
    "tarbela": "Haripur", "kalabagh": "Mianwali", "chashma": "Mianwali",
    "taunsa": "Muzaffargarh", "guddu": "Kashmore", "sukkur": "Sukkur",
    "sukkur barrage": "Sukkur", "kotri": "Jamshoro", "kotri barrage": "Jamshoro",
    "nowshera": "Nowshera", "mangla": "Mirpur", "rasul": "Mandi Bahauddin",
    "marala": "Sialkot", "khanki": "Gujranwala", "qadirabad": "Mandi Bahauddin",
    "trimmu": "Jhang", "panjnad": "Bahawalpur", "jassar": "Narowal",
    "shahdara": "Lahore", "balloki": "Kasur", "sidhnai": "Khanewal",
    "ganda singh wala": "Kasur", "sulemanki": "Okara", "islam": "Vehari",
    "warsak": "Peshawar", "chiniot bridge": "Chiniot",
}
RIVER_DISTRICTS = {
    "indus": ["Haripur", "Mianwali", "Muzaffargarh", "Kashmore", "Sukkur", "Jamshoro"],
    "chenab": ["Sialkot", "Gujranwala", "Mandi Bahauddin", "Hafizabad", "Chiniot", "Jhang", "Muzaffargarh"],
    "jhelum": ["Muzaffarabad", "Mirpur", "Jhelum", "Mandi Bahauddin", "Sargodha", "Jhang"],
    "ravi": ["Narowal", "Lahore", "Kasur", "Okara", "Sahiwal", "Khanewal"],
    "sutlej": ["Kasur", "Okara", "Pakpattan", "Vehari", "Bahawalnagar", "Bahawalpur"],
    "kabul": ["Peshawar", "Nowshera", "Charsadda"],
    "swat": ["Swat", "Charsadda"],
}

# --- fixed values: flood bulletins ------------------------------------------
BULLETIN_PARSER = "ffd-deterministic-v4"
BULLETIN_RIVERS = ["Indus", "Kabul", "Jhelum", "Chenab", "Ravi", "Sutlej"]
BULLETIN_HEADINGS = [  # kind, wording; a bulletin's text runs on one line between them
    ("page", "GOVERNMENT OF PAKISTAN"), ("glance", "Rivers at a glance"), ("scale", "Flood severity scale"), ("rain", "RAINFALL FORECAST"),
    ("hydrology", "I: HYDROLOGICAL SITUATION"), ("hydrology", "1: HYDROLOGICAL SITUATION"), ("warning", "WARNING:"),
    ("features", "II: METEOROLOGICAL FEATURES"), ("day", "III: WEATHER FORECAST FOR 24-HOURS"), ("days", "IV: WEATHER OUTLOOK FOR NEXT 48-HOURS"),
    ("week", "2. WEEKLY WEATHER OUTLOOK"), ("table", "4. QUANTITATIVE FLOOD FORECAST"), ("spatial", "Spatial:"), ("near", "5. HOW CLOSE IS EACH RIVER"),
]
BULLETIN_ENDS = {  # section: kinds of headings that end it
    "glance": ["scale", "rain"], "hydrology": ["warning", "features"], "warning": ["page", "features", "week"],
    "day": ["days", "page"], "days": ["page", "week"], "table": ["spatial", "near"],
}
BULLETIN_TAILS = {  # words that may follow a heading and belong to it
    "hydrology": r"^ ?(?:at \d{4} PST)? ?(?:AND OUTLOOK)?", "table": "^ ?OF GAUGING STATIONS",
}
BULLETIN_COLUMNS = ("RIVERS Stations Actual Observations", "Season 2026")  # first and last words of the table's own head
BULLETIN_TRENDS = {  # trend: phrases that state it
    "Decreasing": ["decrease", "decreasing", "fall", "falling"], "Increasing": ["increase", "increasing", "rise", "rising"],
    "No significant change": ["no sig change", "no sig. change", "no significant change", "no significant. change"],
}
BULLETIN_TIMINGS = {  # what follows: phrases that lead to it
    "date": ["up to", "upto"], "hours": ["within next", "within the next", "during next", "during the next"],
}
BULLETIN_LABELS = {  # fact: label in the page header; its value runs to the next label
    "number": "BULLETIN No:", "issue_date": "Dated:", "issue_time": "Time:", "page": "Page", "office_address": "FLOOD FORECASTING DIVISION",
    "web": "www.", "email": "Email:", "telephone": "Duty Officer 24/7Hrs:", "rights": "All rights",
}
BULLETIN_FOLLOWERS = {"issue_date": "issue_time", "office_address": "number"}  # facts that count only before this label
BULLETIN_OFFICES = {
    "issuing_department": "Flood Forecasting Division", "department": "Pakistan Meteorological Department", "division": "Defence Division",
}
LEVEL_RANK = {
    "below low": 0, "low": 1, "medium": 2, "high": 3, "very high": 4, "exceptionally high": 5,
}

# --- fixed values: report text ----------------------------------------------
ASCII_REPLACEMENTS = [
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"),
    ("—", "-"), ("–", "-"), ("°", " deg "), ("…", "..."),
    ("​", ""), ("‎", ""), ("‏", ""),
]
SAFETY_WORDS = [
    ("rain_flood", ["rain", "flood", "inundation"]),
    ("heat", ["heat"]),
    ("earthquake", ["earthquake", "seismic"]),
    ("storm", ["cyclone", "storm", "wind"]),
]
SAFETY_LINES = {
    "rain_flood": [
        "Avoid unnecessary travel in flood-prone or waterlogged areas.",
        "Stay clear of river beds, storm drains, and open manholes.",
        "Follow emergency updates and evacuation notices from local authorities.",
    ],
    "heat": [
        "Stay hydrated and avoid direct sunlight exposure during peak hours.",
        "Wear lightweight, light-colored, breathable clothing.",
        "Keep vulnerable family members and pets in shaded or cooled environments.",
    ],
    "earthquake": [
        "Drop, Cover, and Hold On during active ground shaking.",
        "Stay away from windows, glass, and unanchored heavy furniture.",
        "Evacuate safely to open outdoor spaces once tremors subside.",
    ],
    "storm": [
        "Secure loose outdoor objects and stay indoors away from windows.",
        "Disconnect non-essential electrical appliances during severe storms.",
        "Do not venture into coastal areas or open waters.",
    ],
    "other": [
        "Stay alert and follow official announcements from local authorities.",
        "Avoid unnecessary travel into high-risk disaster zones.",
        "Keep emergency contact numbers and basic supplies readily available.",
    ],
}

# --- fixed values: IPv4 blocks that are not globally reachable --------------
NON_GLOBAL_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
GLOBAL_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]
