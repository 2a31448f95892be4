"""Vocabularies, thresholds and weights that results depend on."""

# Place categories that are kept.
USABLE_CATEGORIES = (
    "restaurant fast_food_restaurant pizza_restaurant italian_restaurant chinese_restaurant mexican_restaurant american_restaurant cafe "
    "coffee_shop bar bakery delicatessen ice_cream_shop brewery night_club wine_bar pub "
    "park playground garden botanical_garden zoo aquarium beach hiking_trail national_park nature_reserve dog_park "
    "museum art_gallery landmark_and_historical_building monument historical_landmark theater performing_arts_theater concert_hall "
    "library public_library cultural_center train_station subway_station bus_station airport ferry_terminal transportation parking "
    "church_cathedral religious_organization mosque synagogue temple hotel motel resort accommodation bed_and_breakfast "
    "stadium arena amusement_park movie_theater bowling_alley golf_course aquatic_center sports_complex university college "
    "city_hall courthouse post_office fire_station police_station government_office community_center convention_center"
).split()

# Category of a tag's value, by tag.
AMENITY = {
    "restaurant": "restaurant", "fast_food": "fast_food_restaurant", "cafe": "cafe", "bar": "bar", "pub": "pub", "nightclub": "night_club",
    "ice_cream": "ice_cream_shop", "library": "library", "university": "university", "college": "college", "fire_station": "fire_station",
    "police": "police_station", "post_office": "post_office", "townhall": "city_hall", "courthouse": "courthouse",
    "community_centre": "community_center", "parking": "parking", "bus_station": "bus_station", "ferry_terminal": "ferry_terminal",
    "conference_centre": "convention_center", "theatre": "theater", "cinema": "movie_theater",
}
SHOP = {"bakery": "bakery", "deli": "delicatessen", "wine": "wine_bar"}
TOURISM = {
    "museum": "museum", "gallery": "art_gallery", "hotel": "hotel", "motel": "motel", "resort": "resort", "guest_house": "bed_and_breakfast",
    "zoo": "zoo", "aquarium": "aquarium", "theme_park": "amusement_park", "attraction": "landmark_and_historical_building",
}
LEISURE = {
    "park": "park", "playground": "playground", "garden": "garden", "dog_park": "dog_park", "golf_course": "golf_course",
    "stadium": "stadium", "sports_centre": "sports_complex", "nature_reserve": "nature_reserve", "bowling_alley": "bowling_alley",
}
RELIGION = {"christian": "church_cathedral", "muslim": "mosque", "jewish": "synagogue", "buddhist": "temple", "hindu": "temple"}

# Tags that hold other names, in order, and tags that show a presence on the web.
ALIAS_TAGS = ("official_name", "short_name", "alt_name")
WIKI_TAGS = ("wikipedia", "wikidata")
WEB_TAGS = ("website", "contact:website", "contact:facebook", "contact:instagram")

# Boxes as (min lon, min lat, max lon, max lat).
CITIES = {"nyc": (-74.26, 40.49, -73.70, 40.92), "dc": (-77.12, 38.80, -76.90, 38.99), "sf": (-122.52, 37.70, -122.35, 37.83)}

# Matching.
EARTH_M = 6_371_000.0
CELL_M, DEGREE_M, CELL_LATITUDE = 200.0, 111_320.0, 40.7
NEAR_M, NAME_SIMILARITY = 50.0, 0.9
SOURCE_PRIORITY = {"OVERTURE": 0, "OSM": 1}

# Seed score.
SIGNAL_WEIGHT, WIKI_WEIGHT, WEB_WEIGHT, DESTINATION_WEIGHT = 0.1, 2.0, 0.5, 1.5
DESTINATIONS = "landmark_and_historical_building monument train_station subway_station bus_station temple resort stadium university college".split()

# Ranking.
TOP_PLACES, SEED_CAP = 100, 10.0
BLEND = {"popularity": 0.30, "selection": 0.25, "mrr": 0.25, "effort": -0.10, "abandonment": -0.10}
EFFORT_GAP, EFFORT_SELECTION, EFFORT_SCALE = 0.5, 0.5, 20.0
BEHAVIOUR_WEIGHT, CLOSENESS_WEIGHT, DECAY_M = 0.70, 0.30, 2000.0
SHARD_LINES, WINDOW_DAYS, FLUSH_ROWS = 50_000, 30, 500
