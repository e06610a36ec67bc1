"""Fixed values of the rubric: feature registry, policy thresholds, word and domain lists.

All tables here are fixed values that results must agree with; they are given in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

MALICIOUS_SCORES = ("AUTOMATION", "SPAM", "SCAM", "IMPERSONATION", "DECEPTION")

# Thresholds of the scoring policy.
BLOCK_SCORE = 90
REVIEW_SCORE = 65
WEAK_TOTAL_CAP = 15
PATH2_MIN_STRONG_GROUPS = 3
REVIEW_MIN_MODERATE_GROUPS = 2
CONTRARY_HUMAN_CONTINUITY = 30
NETWORK_REVIEW_SCORE = 65
CANDIDATE_CLUSTER_CAP = 49
CLUSTER_MIN_MODERATE = 3
W006_FOLLOW_RATIO = 10
W006_MIN_FOLLOWING = 300
WINDOW_DAYS = 7
SUFFICIENT_AT, PARTIAL_AT = 70, 45
REPURPOSED_AT = 50
HELD_FACTOR = 0.75
WILSON_Z = 1.96
STALE_FULL_DAYS, STALE_LIGHT_DAYS = 30, 7
MIN_SHARED_PREFIX_PATH = 10

# Identifiers that never count as evidence.
FORBIDDEN_PROXIES = (
    "FP_POLITICS", "FP_RACE", "FP_NATIONALITY", "FP_RELIGION", "FP_GENDER", "FP_SEXUAL_ORIENTATION", "FP_LANGUAGE", "FP_POOR_GRAMMAR", "FP_USERNAME_DIGITS",
    "FP_ACCOUNT_AGE", "FP_FOLLOWER_COUNT", "FP_COUNTRY", "FP_VPN_SUSPICION", "FP_DISAGREES_WITH_OWNER", "FP_UNUSUAL_OPINIONS", "FP_ANONYMOUS", "FP_LOW_ACTIVITY_AS_HUMAN",
)

# Feature groups of the decision tiers.
STRONG_BASIS = ("I001", "S004", "S008")
PERSONA = ("I002", "I003", "I005")
FUNNEL = ("S005", "S010")
LURE = ("S006", "S012", "S016")
LINK_COMPANIONS = ("I001", "I002", "I003", "I004", "I005", "S004", "S006", "S012", "S016")
SOLICIT = ("S004", "S005", "S006", "S010", "S012", "S016")
REPURPOSED_SOLICIT = ("S004", "S005", "S006", "S010", "S012", "S013", "S016")
LINK_BASIS = ("S006", "S008", "S010", "S011")
REPEAT_BASIS = ("S004", "S003", "S009", "A001")
QUOTE_BASIS = ("I001", "I002", "I003")
ESCALATE_FEATURES = ("I001", "I002", "I003", "I005", "S004", "S005", "S006", "S008", "S010", "S011", "S016", "D006", "D007")
MODEL_EXCLUDED_PREFIX_BASIS = ("S", "I", "OP_")

# Phrases that say nothing, and words that carry no content.
GENERIC_PHRASES = (
    "good morning", "gm", "good night", "gn", "hello", "hi", "hey", "hello there", "hi there", "thanks", "thank you",
    "thank you so much", "congratulations", "congrats", "wow", "nice", "amazing", "awesome", "love this", "love it",
    "so true", "agreed", "yes", "no", "dm", "pm", "yes pm", "follow back", "follow me", "how are you", "how are you doing",
    "hello how are you", "hello sir how are you doing", "hello dear", "hello friend", "beautiful", "great", "cool", "lol",
    "happy birthday", "god bless", "god bless you", "keep it up", "well said", "exactly", "true", "facts", "same",
)
STOP_WORDS = (
    "a an the and or but to of in on at for with is are was were be been it its this that i you he she we they me my your our their "
    "so do does did not no yes just very really from by as if then than there here what who how why when"
).split()

# Domains, hosts and parameters.
COMMON_DOMAINS = (
    "x.com", "twitter.com", "t.co", "youtube.com", "youtu.be", "instagram.com", "facebook.com", "tiktok.com",
    "linktr.ee", "google.com", "bit.ly", "tesla.com", "spacex.com", "linkedin.com", "github.com", "medium.com",
)
CHAT_HOSTS = {
    "t.me": "telegram", "telegram.me": "telegram", "telegram.dog": "telegram", "wa.me": "whatsapp", "api.whatsapp.com": "whatsapp",
    "chat.whatsapp.com": "whatsapp", "whatsapp.com": "whatsapp", "services.zangi.com": "zangi", "zangi.com": "zangi", "zangi.me": "zangi",
}
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rebrand.ly", "shorturl.at", "rb.gy", "tiny.cc", "linktr.ee", "lnkd.in")
MOBILE_HOSTS = ("x.com", "twitter.com", "facebook.com", "youtube.com")
TEXT_TRACKING = r"^(utm_[a-z_]+|fbclid|gclid|dclid|igshid|mc_cid|mc_eid|ref_src|ref_url|s|t|si|trk|cn|feature)$"
LINK_TRACKING = r"^(utm_.*|fbclid|gclid|dclid|msclkid|mc_eid|mc_cid|igshid|si|ref|ref_src|ref_url|s|t|_ga|yclid|twclid)$"

# Words of themes that never join accounts, of personas, and of solicitation.
TOPIC = r"\b(maga|trump|biden|patriot|america|god bless|jesus|elon|musk|tesla|spacex|doge|bitcoin|crypto|nigeria|usa|texas|fan|fans|support|love you|proud)\b"
PERSONA_WORDS = r"\b(tesla|spacex|space ?x|xai|x ?ai|elon|musk|neuralink|starlink|ceo|founder|official|doge ?father)\b"
SOLICITATION = r"(telegram|whats\s?app|zangi|signal|t\.me/|wa\.me/|dm me|text me|send me|inbox me|wallet|invest|crypto|giveaway|prize|claim|recover(y)?|cash ?app|gift ?card)"

# Look-alike letters and digits.
HOMOGLYPHS = (
    "авеёкмнорстухіїјѕԁӏһԛԝɩлαβεικμνορτυχℓı|$@€",
    "abeekmhopctyxiijsdlhqwllabeikmvoptuxlilsae",
)
LEET_L = ("01345789", "oleastbg")
LEET_I = ("01345789", "oieastbg")
ROLE_WORDS = (
    "musk", "tesla", "spacex", "ceo", "official", "offical", "real", "iam", "itsme", "its", "team", "assistant", "assistent", "manager", "management", "support", "helpdesk", "giveaway",
    "founder", "private", "personal", "xai", "neuralink", "verified", "office", "secretary", "agent", "rep",
)
PARTNER_WORDS = ("elon", "tesla", "spacex", "ceo")
COMPACT_TERMS = ("elonmusk", "mrmusk", "teslaceo", "spacexceo", "ceooftesla", "ceoofspacex", "teslafounder", "spacexfounder", "founderoftesla", "founderofspacex")

# What states, decisions and labels may say.
ENUMERATIONS = {
    "account_nature": ("HUMAN_LIKELY", "AUTOMATION_LIKELY", "MIXED_OR_ASSISTED", "UNKNOWN"),
    "classification": ("NORMAL", "SPAM", "SCAM", "IMPERSONATION", "COORDINATED_NETWORK", "REPURPOSED_ACCOUNT"),
    "enforcement": ("KEEP", "REVIEW", "BLOCK_CANDIDATE", "BLOCK_CONFIRMED"),
    "outcome": ("KEEP", "LOW_EVIDENCE_KEEP", "REVIEW", "REVIEW_INSUFFICIENT_DATA", "BLOCK_CANDIDATE", "BLOCK_CONFIRMED", "UNKNOWN"),
    "evidence_state": ("SUFFICIENT", "PARTIAL", "INSUFFICIENT", "UNAVAILABLE"),
    "nature_label": ("BOT_LIKELY", "HUMAN_LIKELY"),
    "failure": ("COLLECTION_FAILURE", "FEATURE_EXTRACTION_FAILURE", "SCORING_FAILURE", "DECISION_THRESHOLD_FAILURE", "LABEL_AMBIGUITY"),
    "behavior": ("PROFILE_HISTORY", "ORIGINAL_POSTS", "REPLIES", "REPOSTS", "QUOTES", "EXTERNAL_LINKS", "OLDER_CONTENT"),
}

# Features in an owner's words.
FEATURE_WORDS = {
    "I001": "claims to be a real public figure", "I002": "claims a role with a public figure or company", "I003": "uses a public figure's name or look", "I005": "claims to act for a public figure",
    "S004": "sends the same scam script to many people", "S005": "pushes people to DM it", "S006": "crypto giveaway pitch", "S008": "links to a known malicious site", "S010": "pushes people to Telegram/WhatsApp",
    "S011": "adult-cam link", "S012": "prize or money bait", "S016": "investment or money pitch", "OP_IDENTITY": "matches your protected-identity rule", "OP_RULE": "matches one of your rules",
    "S001": "engagement bait", "S009": "repeated promo posts", "S018": "follow-back farming", "I004": "copied a public figure's facts", "S002": "giveaway-entry spam replies", "S003": "repeated unsolicited promo",
    "S007": "referral codes", "S013": "cold openers to strangers", "S014": "amplifies scam accounts", "S015": "self-promotion",
}

# Weights of the coverage components.
COVERAGE = {"PROFILE": 15, "ABOUT_PAGE": 15, "ORIGINAL_POSTS": 20, "REPLIES": 15, "OLDER_CONTENT": 15, "LINKS_CONTACTS": 10, "COUNTS": 10}


@dataclass(frozen=True)
class Feature:
    feature_id: str
    category: str
    weights: dict[str, int]
    per_extra: int
    cap: int
    strength: str
    corroborated: bool
    corroborated_score: str | None
    can_block: bool
    fact_group: str
    min_count: int


#: The feature registry in its natural order, with each feature's weight per score.
FEATURES: tuple[Feature, ...] = (
    Feature("A001", "AUTOMATION", {"AUTOMATION": 25, "SPAM": 10, "HUMAN_CONTINUITY": -10}, 1, 35, "STRONG", False, None, False, "REPEATED_OUTBOUND_TEXT", 10),
    Feature("A002", "AUTOMATION", {"AUTOMATION": 20, "SPAM": 10, "HUMAN_CONTINUITY": -5}, 0, 20, "MODERATE", False, None, False, "REPEATED_OUTBOUND_TEXT", 3),
    Feature("A003", "AUTOMATION", {"AUTOMATION": 15, "SPAM": 10, "HUMAN_CONTINUITY": -10}, 1, 25, "MODERATE", False, None, False, "GENERIC_REPLIES", 5),
    Feature("A004", "AUTOMATION", {"AUTOMATION": 25, "SPAM": 10, "HUMAN_CONTINUITY": -20}, 0, 25, "MODERATE", False, None, False, "GENERIC_REPLIES", 1),
    Feature("A005", "AUTOMATION", {"AUTOMATION": 10, "HUMAN_CONTINUITY": -15}, 0, 10, "MODERATE", True, None, False, "THREAD_DEPTH", 20),
    Feature("A006", "AUTOMATION", {"AUTOMATION": 10, "HUMAN_CONTINUITY": -10}, 0, 10, "MODERATE", True, None, False, "CONTENT_MIX", 1),
    Feature("A007", "AUTOMATION", {"AUTOMATION": 10, "SPAM": 5, "HUMAN_CONTINUITY": -10}, 0, 10, "MODERATE", True, None, False, "CONTENT_MIX", 1),
    Feature("A008", "AUTOMATION", {"AUTOMATION": 10}, 0, 10, "MODERATE", True, None, False, "SYNC_POSTING", 3),
    Feature("A009", "AUTOMATION", {"AUTOMATION": 20}, 0, 20, "MODERATE", False, None, False, "TIMING", 1),
    Feature("A010", "AUTOMATION", {"AUTOMATION": 15, "SPAM": 5}, 0, 15, "MODERATE", False, None, False, "TIMING", 1),
    Feature("A011", "AUTOMATION", {"AUTOMATION": 5}, 0, 5, "WEAK", True, None, False, "SHELL", 1),
    Feature("A012", "AUTOMATION", {"AUTOMATION": 10, "DECEPTION": 10, "HUMAN_CONTINUITY": -5}, 0, 10, "MODERATE", True, None, False, "HIDDEN_HISTORY_PERSONA", 1),
    Feature("S001", "SPAM", {"SPAM": 25}, 5, 35, "MODERATE", False, None, False, "ENGAGEMENT_BAIT", 1),
    Feature("S002", "SPAM", {"SPAM": 15, "AUTOMATION": 10, "HUMAN_CONTINUITY": -5}, 0, 15, "MODERATE", False, None, False, "REPEATED_OUTBOUND_TEXT", 5),
    Feature("S003", "SPAM", {"SPAM": 30, "AUTOMATION": 10}, 2, 40, "MODERATE", False, None, False, "REPEATED_OUTBOUND_TEXT", 5),
    Feature("S004", "SCAM", {"SCAM": 35, "SPAM": 35, "AUTOMATION": 10}, 5, 50, "STRONG", False, None, True, "REPEATED_OUTBOUND_TEXT", 2),
    Feature("S005", "SCAM", {"SCAM": 20, "SPAM": 15}, 5, 30, "MODERATE", False, None, False, "DM_FUNNEL", 1),
    Feature("S006", "SCAM", {"SCAM": 35, "SPAM": 20}, 0, 35, "MODERATE", False, None, False, "CRYPTO_AIRDROP", 1),
    Feature("S007", "SPAM", {"SPAM": 15, "SCAM": 5}, 0, 15, "MODERATE", False, None, False, "REFERRAL", 1),
    Feature("S008", "SCAM", {"SCAM": 45, "SPAM": 10}, 0, 45, "STRONG", False, None, True, "MALICIOUS_DESTINATION", 1),
    Feature("S009", "SPAM", {"SPAM": 25, "AUTOMATION": 10}, 1, 30, "MODERATE", False, None, False, "TEMPLATED_PROMO", 5),
    Feature("S010", "SPAM", {"SPAM": 25, "SCAM": 20}, 5, 35, "MODERATE", False, None, False, "OFFPLATFORM_FUNNEL", 1),
    Feature("S011", "SPAM", {"SPAM": 40, "SCAM": 15}, 0, 40, "STRONG", False, None, False, "ADULT_FUNNEL", 1),
    Feature("S012", "SCAM", {"SCAM": 25, "SPAM": 15}, 0, 25, "MODERATE", False, None, False, "GIVEAWAY_LURE", 1),
    Feature("S013", "SCAM", {"SCAM": 10, "SPAM": 5}, 0, 10, "WEAK", True, None, False, "BEFRIENDING_OPENERS", 2),
    Feature("S014", "SCAM", {"SCAM": 10, "SPAM": 10}, 0, 10, "WEAK", True, None, False, "AMPLIFIES_SCAM", 1),
    Feature("S015", "SPAM", {"SPAM": 20}, 0, 20, "MODERATE", False, None, False, "SELF_PROMO", 1),
    Feature("S016", "SCAM", {"SCAM": 30}, 0, 30, "MODERATE", False, None, False, "INVESTMENT_SOLICITATION", 1),
    Feature("S018", "SPAM", {"SPAM": 15}, 5, 20, "MODERATE", False, None, False, "FOLLOW_BACK_FARMING", 2),
    Feature("I001", "IMPERSONATION", {"IMPERSONATION": 90, "DECEPTION": 20}, 0, 90, "STRONG", False, None, True, "IDENTITY_CLAIM", 1),
    Feature("I002", "IMPERSONATION", {"IMPERSONATION": 40, "DECEPTION": 15}, 0, 40, "MODERATE", False, None, False, "IDENTITY_CLAIM", 1),
    Feature("I003", "IMPERSONATION", {"IMPERSONATION": 45}, 0, 45, "MODERATE", False, None, False, "PERSONA_PRESENTATION", 1),
    Feature("I004", "IMPERSONATION", {"IMPERSONATION": 30}, 0, 30, "MODERATE", False, None, False, "PERSONA_FACTS", 1),
    Feature("I005", "IMPERSONATION", {"SCAM": 30, "IMPERSONATION": 20}, 0, 30, "MODERATE", False, None, False, "FAKE_REPRESENTATIVE", 1),
    Feature("D001", "DECEPTION", {"DECEPTION": 25}, 0, 25, "MODERATE", True, None, False, "LOCATION_MISMATCH", 1),
    Feature("D002", "DECEPTION", {"DECEPTION": 25}, 0, 25, "MODERATE", False, None, False, "IDENTITY_CONTRADICTION", 1),
    Feature("D003", "DECEPTION", {"DECEPTION": 20}, 0, 20, "MODERATE", False, None, False, "FAKE_STATS", 1),
    Feature("D004", "DECEPTION", {"DECEPTION": 10}, 0, 10, "WEAK", True, None, False, "SYNTHETIC_PERSONA", 1),
    Feature("D005", "DECEPTION", {"DECEPTION": 25}, 0, 25, "MODERATE", False, None, False, "SYNTHETIC_PERSONA", 2),
    Feature("D006", "DECEPTION", {"DECEPTION": 35, "SCAM": 15}, 0, 35, "MODERATE", False, None, False, "BACKUP_CLAIM", 1),
    Feature("D007", "DECEPTION", {"DECEPTION": 20, "AUTOMATION": 10, "HUMAN_CONTINUITY": -15}, 0, 20, "MODERATE", False, "AUTOMATION", False, "IDENTITY_CHANGE", 1),
    Feature("W001", "AUTOMATION", {"AUTOMATION": 5, "SPAM": 5, "SCAM": 5}, 0, 5, "WEAK", True, None, False, "ACCOUNT_AGE", 1),
    Feature("W002", "AUTOMATION", {"AUTOMATION": 3, "DECEPTION": 3}, 0, 3, "WEAK", True, None, False, "USERNAME_PATTERN", 1),
    Feature("W003", "DECEPTION", {"DECEPTION": 5, "AUTOMATION": 3}, 0, 5, "WEAK", True, None, False, "DISPLAY_NAME_MISMATCH", 1),
    Feature("W004", "AUTOMATION", {"AUTOMATION": 5, "SPAM": 3}, 0, 5, "WEAK", True, None, False, "FOLLOW_GRAPH", 1),
    Feature("W005", "DECEPTION", {"DECEPTION": 5}, 0, 5, "WEAK", True, None, False, "IDENTITY_CHANGE", 1),
    Feature("W006", "SPAM", {"SPAM": 5}, 0, 5, "WEAK", True, None, False, "FOLLOW_GRAPH", 1),
    Feature("N001", "NETWORK", {"NETWORK_COORDINATION": 60}, 0, 60, "STRONG", False, None, False, "NETWORK", 1),
    Feature("N002", "NETWORK", {"NETWORK_COORDINATION": 20}, 0, 60, "MODERATE", False, None, False, "NETWORK", 1),
    Feature("N003", "NETWORK", {"NETWORK_COORDINATION": 5}, 0, 15, "WEAK", False, None, False, "NETWORK", 1),
    Feature("H001", "HUMAN", {"HUMAN_CONTINUITY": 15, "AUTOMATION": -5}, 0, 15, "MODERATE", False, None, False, "H_CONTEXT_REPLIES", 1),
    Feature("H002", "HUMAN", {"HUMAN_CONTINUITY": 10, "AUTOMATION": -5}, 0, 10, "MODERATE", False, None, False, "H_PAST_REFERENCES", 1),
    Feature("H003", "HUMAN", {"AUTOMATION": -15, "HUMAN_CONTINUITY": 20}, 0, 20, "STRONG", False, None, False, "H_CONVERSATIONS", 1),
    Feature("H004", "HUMAN", {"HUMAN_CONTINUITY": 15, "AUTOMATION": -5}, 0, 15, "MODERATE", False, None, False, "H_LONG_TERM", 1),
    Feature("H005", "HUMAN", {"HUMAN_CONTINUITY": 10, "AUTOMATION": -5}, 0, 10, "MODERATE", False, None, False, "H_ORIGINAL", 1),
    Feature("H006", "HUMAN", {"HUMAN_CONTINUITY": 5}, 0, 5, "WEAK", False, None, False, "H_RHYTHM", 1),
    Feature("H007", "HUMAN", {"HUMAN_CONTINUITY": 15, "AUTOMATION": -5}, 0, 15, "MODERATE", False, None, False, "H_RECOGNITION", 1),
    Feature("H008", "HUMAN", {"IMPERSONATION": -40}, 0, 40, "MODERATE", False, None, False, "H_HONEST_LABEL", 1),
    Feature("H009", "HUMAN", {"HUMAN_CONTINUITY": 10, "AUTOMATION": -5}, 0, 10, "MODERATE", False, None, False, "H_PERSONAL", 1),
    Feature("H010", "HUMAN", {"HUMAN_CONTINUITY": 10, "AUTOMATION": -5}, 0, 10, "MODERATE", False, None, False, "H_CONVERSATIONS", 1),
)
