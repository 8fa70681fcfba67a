"""Fixed lookup values.

FIXED VALUES: everything in this module is a constant of the data model
(gazetteer, taxonomy, keyword slots, provider defaults, colours, class
vocabularies). They must stay equal to the published definitions or results
change.
"""

from __future__ import annotations

# Areas of interest with imagery: (key, display name, lat, lon, aliases), in match order.
INDEXED_AREAS = [
    ("tumakuru", "Tumakuru Region / Industrial Corridor, Karnataka", 13.3408, 77.1009,
     ["tumakuru", "tumkur", "tumakuru corridor", "vasantha narasapura", "tumkur district", "karnataka industrial"]),
    ("krishna", "Krishna River Basin / Delta, Andhra Pradesh", 16.2000, 80.5000,
     ["krishna", "krishna basin", "krishna delta", "krishna river", "vijayawada", "andhra basin",
      "andhra pradesh river"]),
    ("ennore", "Ennore Coastal Region, Tamil Nadu", 13.2350, 80.3250,
     ["ennore", "ennore port", "kamarajar port", "ennore coastal", "coromandel coast", "tamil nadu port"]),
]

# Known places without imagery: (alias, formal name), in match order.
UNINDEXED_PLACES = [
    ("bengaluru", "Bengaluru"), ("bangalore", "Bengaluru"), ("hyderabad", "Hyderabad"),
    ("secunderabad", "Hyderabad"), ("telangana", "Telangana"), ("mumbai", "Mumbai"), ("delhi", "Delhi NCR"),
    ("new delhi", "Delhi NCR"), ("kolkata", "Kolkata"), ("pune", "Pune"), ("ahmedabad", "Ahmedabad"),
    ("chennai", "Chennai City"), ("chennai city", "Chennai City"), ("jaipur", "Jaipur"), ("kochi", "Kochi"),
    ("cochin", "Kochi"), ("kerala", "Kerala"), ("goa", "Goa"), ("gurgaon", "Gurgaon"), ("noida", "Noida"),
    ("lucknow", "Lucknow"), ("chandigarh", "Chandigarh"), ("visakhapatnam", "Visakhapatnam"),
    ("vizag", "Visakhapatnam"),
]

# Words that can follow a place preposition without naming a place.
PLACE_STOPWORDS = ["between", "from", "the", "recent", "major", "large", "new", "satellite", "earth"]

PLACE_PREPOSITIONS = ["around", "near", "in", "at", "across", "region of"]

# Change taxonomy: category -> keywords; a keyword with a space is matched as a phrase.
TAXONOMY = {
    "VEGETATION": [
        "vegetation", "loss", "deforestation", "forest", "tree", "trees", "agriculture", "crop", "farmland",
        "farming", "greenery", "canopy", "biomass", "flora", "green cover", "soil", "rural"],
    "URBAN_EXPANSION": [
        "urban", "expansion", "encroachment", "settlement", "sprawl", "built-up", "residential", "city growth",
        "development", "built surface"],
    "CONSTRUCTION_INDUSTRIAL": [
        "construction", "industrial", "shed", "factory", "superstructure", "building", "buildings", "high-tech",
        "manufacturing", "corridor", "industrial hub", "infrastructure"],
    "SOLAR_ENERGY": [
        "solar", "photovoltaic", "pv", "solar array", "solar park", "renewable", "clean energy", "solar panel",
        "panels"],
    "WATER_FLOOD": [
        "water", "water-body", "waterbody", "flood", "flooding", "inundation", "river", "delta", "basin", "lake",
        "reservoir", "submerged", "drainage"],
    "PORT_INFRASTRUCTURE": [
        "port", "terminal", "logistics", "harbor", "harbour", "coastal", "shipping", "dock", "docks", "berth",
        "wharf", "marine"],
}

# Keyword -> slot of the 512-dim text/image embedding; the vector index is slot * 12.
KEYWORD_SLOTS = {
    "construction": 0, "building": 1, "urban": 2, "expansion": 3, "infrastructure": 4, "water": 5, "river": 6,
    "lake": 7, "reservoir": 8, "flood": 9, "flooding": 10, "agriculture": 11, "crop": 12, "farmland": 13,
    "vegetation": 14, "forest": 15, "deforestation": 16, "solar": 17, "photovoltaic": 18, "energy": 19,
    "industrial": 20, "corridor": 21, "mining": 22, "quarry": 23, "road": 24, "bridge": 25, "port": 26,
    "airport": 27, "runway": 28, "residential": 29, "commercial": 30, "coastal": 31, "wetland": 32, "barren": 33,
    "soil": 34, "damage": 35, "disaster": 36, "settlement": 37,
}
EMBEDDING_DIM = 512
SLOT_WIDTH = 12
KEYWORD_WEIGHTS = (3.5, 2.8, 2.1)

# Tile profiles: (tile_id, aoi, primary types, category, description, year).
TILE_PROFILES = [
    ("tile_tumakuru_base_02", "tumakuru", ["VEGETATION"], "Agriculture & Soil Baseline",
     "Baseline rural cropland and soil coverage prior to industrial conversion.", 2024),
    ("tile_tumakuru_ind_01", "tumakuru", ["URBAN_EXPANSION", "CONSTRUCTION_INDUSTRIAL", "SOLAR_ENERGY"],
     "New Construction / Solar Array",
     "High-tech industrial superstructures and photovoltaic array expansion.", 2026),
    ("tile_krishna_flood_03", "krishna", ["WATER_FLOOD"], "Flood Inundation & River Basin",
     "Monsoon flood inundation across lower agricultural basin parcels.", 2026),
    ("tile_chennai_port_04", "ennore", ["PORT_INFRASTRUCTURE", "CONSTRUCTION_INDUSTRIAL"],
     "Port Logistics & Marine Terminal",
     "Coastal shipping logistics berths, container berths, and breakwaters.", 2026),
]

# Catalogue ids that stand for another tile record.
METADATA_ALIASES = {
    "tile_tumakuru_ind_01": "tile_tumakuru_02",
    "tile_tumakuru_base_02": "tile_tumakuru_01",
    "tile_krishna_flood_03": "tile_krishna_flood_03",
    "tile_chennai_port_04": "tile_chennai_port_04",
    "res_001": "tile_tumakuru_02",
    "res_002": "tile_krishna_flood_03",
}

# Providers: source -> platform, instrument, gsd, default cloud (None: forced 0), bands, properties.
PROVIDERS = {
    "Sentinel-2": ("Sentinel-2A/B", "MSI", 10.0, 4.2,
                   ["B02_Blue", "B03_Green", "B04_Red", "B08_NIR", "SCL_SceneClass"], "Level-2A BOA"),
    "Sentinel-1": ("Sentinel-1A/B", "C-SAR", 10.0, None,
                   ["VV_amplitude", "VH_amplitude", "coherence"], "GRD Level-1"),
    "Landsat-8/9": ("Landsat-9", "OLI-2/TIRS-2", 30.0, 6.8,
                    ["SR_B2_Blue", "SR_B3_Green", "SR_B4_Red", "SR_B5_NIR", "ST_B10_Thermal"], "Collection 2 L2SP"),
    "ISRO-Bhuvan": ("Resourcesat-2A", "LISS-IV", 5.8, 2.1, ["Green", "Red", "NIR"], None),
}
DEFAULT_BBOX = [77.0, 13.0, 77.2, 13.2]

PLATFORM_ALIASES = {
    "s2a": "sentinel-2a", "s2b": "sentinel-2b", "s2c": "sentinel-2c", "s1a": "sentinel-1a", "s1b": "sentinel-1b",
    "landsat-8": "landsat-8", "landsat-9": "landsat-9", "landsat8": "landsat-8", "landsat9": "landsat-9",
    "lc08": "landsat-8", "lc09": "landsat-9",
}

RASTER_EXTENSIONS = [".tif", ".tiff", ".cog", ".json", ".geojson"]

# Quality mask: bit value per flag, and Sentinel-2 scene classes per flag.
QA_BITS = {"valid_data": 1, "cloud": 2, "cloud_shadow": 4, "snow": 8, "haze": 16, "water": 32, "saturated": 64,
           "cirrus": 128}
QA_BAD_FLAGS = ["cloud", "cloud_shadow", "snow", "haze", "saturated", "cirrus"]
SCL_CLASSES = {"saturated": [1], "cloud_shadow": [3], "water": [6], "cloud": [8, 9], "cirrus": [10], "snow": [11],
               "usable": [2, 4, 5, 6, 7]}
SCL_CLOUD_CLASSES = [3, 8, 9, 10]

# RGB report categories: code -> (type, label, colour red, green, blue, alpha, summary text).
REPORT_CATEGORIES = {
    "flood": ("Flood / Water-Body Inundation", "Flood / Water-Body Inundation", 30, 144, 255, 210,
              "Severe water body expansion and inundation detected"),
    "vegetation": ("Deforestation / Vegetation Loss", "Deforestation / Land Clearing", 220, 20, 60, 210,
                   "Vegetation canopy removal and bare soil exposure detected"),
    "construction": ("New Construction / Urban Expansion", "New Construction / Urban Expansion", 255, 69, 0, 220,
                     "Urban structural construction and impervious surface expansion detected"),
    "solar": ("Solar Array / Industrial Facility", "Solar Array / Industrial Facility", 138, 43, 226, 210,
              "Photovoltaic array or industrial high-albedo/low-reflectance roofing detected"),
    "other": ("New Construction / Urban Expansion", "New Infrastructure Development", 255, 69, 0, 220,
              "Significant structural land-use change detected"),
}

MORPHOLOGY_CLASSES = ["appearance", "disappearance", "expansion", "contraction", "none"]
TYPE_CLASSES = ["construction", "clearance", "water_extent", "road", "unknown"]
