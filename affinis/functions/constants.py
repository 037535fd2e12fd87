"""Fixed values of the linkage: word lists, lookup tables, weights and limits."""

from __future__ import annotations

# Legal forms at the end of a business name.
LEGAL_SUFFIXES = (
    "private limited", "pvt limited", "pvt ltd", "private ltd", "public limited", "public ltd",
    "limited", "ltd", "incorporated", "inc", "corporation", "corp", "llc", "llp", "plc", "gmbh", "sarl", "sas", "sa", "company", "co",
)

# Phrases between a business name and its alias.
ALIAS_MARKERS = ("doing business as", "formerly known as", "trading as", "trading under", "t a", "f k a", "d b a", "dba", "aka")

# Abbreviations in addresses.
ADDRESS_WORDS = {
    "rd": "road", "rdg": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "boul": "boulevard",
    "dr": "drive", "ln": "lane", "hwy": "highway", "pkwy": "parkway", "pl": "place", "sq": "square", "ste": "suite", "apt": "apartment",
    "fl": "floor", "bldg": "building", "blk": "block", "ctr": "center", "col": "colony", "no": "number", "kh": "khasra", "sec": "sector",
    "dist": "district", "opp": "opposite", "nr": "near", "r": "rue", "appt": "apartment", "bd": "boulevard", "rte": "route", "che": "chemin",
    "imp": "impasse", "res": "residence", "bat": "building", "n": "north", "s": "south", "e": "east", "w": "west",
}

# Abbreviations in business names.
NAME_WORDS = {
    "intl": "international", "intnl": "international", "mfg": "manufacturing", "tech": "technology", "technol": "technology",
    "indl": "industrial", "svc": "services", "svcs": "services", "hosp": "hospital",
}

# Names of countries.
COUNTRY_ALIASES = {
    "usa": "us", "united states": "us", "united states of america": "us", "in": "india", "republic of india": "india",
    "fr": "france", "french republic": "france",
}
COUNTRY_COMPONENTS = ("us", "usa", "united states", "united states of america", "india", "republic of india", "france", "french republic")

# Words that make no blocking key.
STOP_WORDS = (
    "a", "an", "and", "at", "by", "co", "company", "corp", "corporation", "for", "from", "global", "group", "inc", "incorporated", "india",
    "international", "limited", "llc", "llp", "ltd", "of", "on", "pvt", "private", "services", "the", "to", "trading", "usa", "us", "solutions",
    "technology", "technologies", "street", "road", "avenue", "boulevard", "drive", "lane", "highway", "parkway", "suite", "apartment",
    "building", "floor", "unit", "near", "opposite", "khasra",
)

# States by code.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee",
    "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin",
    "wy": "wyoming", "dc": "district of columbia",
}
INDIAN_STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
    "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
    "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh",
    "puducherry", "chandigarh", "andaman and nicobar islands", "dadra and nagar haveli and daman and diu", "lakshadweep",
)
INDIAN_CODES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "ch": "chandigarh", "ct": "chhattisgarh", "dl": "delhi", "ga": "goa", "gj": "gujarat",
    "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh",
    "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "or": "odisha", "pb": "punjab",
    "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand",
    "wb": "west bengal", "jk": "jammu and kashmir",
}

# Words before a unit number, and before a landmark.
UNIT_WORDS = ("unit", "apartment", "suite", "floor", "flat", "room")
LANDMARK_WORDS = ("near", "opposite", "behind", "beside", "adjacent", "landmark")

# Retrieval channels with weight, limit and multiple of the frequency ceiling.
CHANNELS = {
    "name_exact": (10.0, 100, 4), "name_pair": (8.0, 150, 2), "name_char_ngram": (4.0, 100, 1), "name_phonetic": (3.0, 60, 1),
    "name_tfidf": (8.0, 50, 1), "name_token": (7.0, 200, 1), "address_token": (2.5, 200, 1), "postal": (9.0, 100, 4),
    "house_number": (7.0, 100, 4), "city_token": (1.5, 50, 1),
}

# Ranks at which recall is reported, and candidates below which a fallback is used.
RECALL_RANKS = (50, 100, 200, 500, 1000)
FALLBACK_BELOW = 5

# The margins that a threshold sweep tries; no margin comes last.
MARGINS = (0.05, 0.1, 0.2, 0.35, 0.5, None)

# Pair features in their order.
PAIR_FEATURES = (
    "name_exact", "name_core_exact", "name_token_jaccard", "name_token_containment", "name_char_similarity", "name_jaro_winkler",
    "name_char_ngram_jaccard", "name_char_ngram_cosine", "name_tfidf_cosine", "name_sorted_token_similarity", "name_token_order_similarity",
    "candidate_retrieval_rank_reciprocal", "candidate_retrieval_score", "name_prefix_similarity", "name_suffix_similarity",
    "name_variant_similarity", "name_length_ratio", "common_name_tokens", "name_rare_token_overlap", "address_exact", "address_token_jaccard",
    "address_token_containment", "address_char_similarity", "address_char_ngram_jaccard", "address_char_ngram_cosine", "address_tfidf_cosine",
    "address_length_ratio", "common_address_tokens", "address_rare_token_overlap", "address_landmark_overlap", "number_token_jaccard",
    "house_number_match", "house_number_base_match", "house_number_suffix_conflict", "house_number_conflict", "unit_number_match",
    "unit_number_conflict", "postal_code_match", "postal_code_conflict", "city_token_jaccard", "city_exact", "state_match", "state_conflict",
    "tail_component_similarity", "same_country", "country_conflict", "name_address_consistency", "city_name_consistency",
    "name_postal_consistency", "phone_fragment_match", "cross_source_cluster_size", "cross_source_support_count", "s2_s3_name_similarity",
    "s2_s3_address_similarity", "s2_s3_cluster_agreement", "cross_source_candidate_support_count", "cross_source_candidate_agreement",
    "cross_source_direct_edge_count", "cross_source_max_edge_score", "cross_source_min_edge_score", "cross_source_avg_edge_score",
    "candidate_source_s2", "candidate_source_s3", "candidate_retrieval_channel_count", "candidate_block_name_phonetic",
    "candidate_block_name_tfidf", "contradiction_score", "address_layout_country_plausibility", "address_layout_pattern_match",
    "postal_country_pattern_support", "has_name_both", "has_address_both",
)

# Entity features in their order.
ENTITY_FEATURES = (
    "best_probability", "second_probability", "probability_gap", "top3_probability_mean", "probability_std", "log_candidate_count",
    "number_above_pair_threshold", "best_name_score", "best_address_score", "best_country_score", "best_name_rank_reciprocal",
    "best_address_rank_reciprocal", "best_candidate_rank_reciprocal", "logit_gap", "top1_top2_ratio", "top1_top3_gap", "top1_name_score",
    "top2_name_score", "top1_address_score", "top2_address_score", "top1_postal_match", "top2_postal_match", "top1_house_match",
    "top2_house_match", "exact_name_count", "exact_address_count", "exact_postal_count", "name_exact_block_count", "name_pair_block_count",
    "name_char_block_count", "name_phonetic_block_count", "name_tfidf_block_count", "name_token_block_count", "address_token_block_count",
    "postal_block_count", "house_number_block_count", "city_token_block_count", "s2_candidate_count", "s3_candidate_count",
    "best_s2_probability", "best_s3_probability", "best_s2_s3_probability_gap", "top1_country_conflict", "top2_country_conflict",
    "top1_postal_conflict", "top2_postal_conflict", "top1_house_conflict", "top2_house_conflict", "top1_exact_name", "top2_exact_name",
    "top1_cross_source_support", "top2_cross_source_support",
)
