"""The word lists, weights and patterns whose exact entries decide results."""

from __future__ import annotations

EMOTE_POLARITY = {
    "OMEGALUL": 0.8, "LUL": 0.7, "LULW": 0.8, "KEKW": 0.8, "ICANT": 0.8, "Pog": 0.9, "PogChamp": 0.9, "POGGERS": 0.9,
    "W": 0.7, "based": 0.7, "TRUE": 0.6, "NODDERS": 0.6, "EZ": 0.6, "Clap": 0.5,
    "L": -0.7, "cap": -0.6, "NOPERS": -0.6, "monkaW": -0.4, "monkaS": -0.4, "Aware": -0.5, "cringe": -0.8,
    "weirdchamp": -0.8, "DESPAIR": -0.7, "???": -0.3, "HUH": -0.3,
}

CROSS_POLARITY = {
    "pog": 0.8, "poggers": 0.85, "w": 0.9, "based": 0.8, "gigachad": 0.85, "true": 0.7, "nodders": 0.7, "clap": 0.6,
    "omegalul": 0.7, "kekw": 0.7, "icant": 0.75, "lul": 0.6, "lulw": 0.65, "fire": 0.8, "goat": 0.9, "letsgo": 0.8,
    "l": -0.85, "cringe": -0.8, "cap": -0.75, "nopers": -0.7, "weirdchamp": -0.85, "monkaw": -0.5, "aware": -0.6,
    "despair": -0.7, "cooked": -0.8, "ratio": -0.7, "scam": -0.9, "boo": -0.8, "trash": -0.9, "mid": -0.6,
}

AGREEMENT_TOKENS = ["TRUE", "true", "based", "Based", "W", "w", "NODDERS", "real", "Facts", "facts", "Clap"]
DISSENT_TOKENS = ["L", "l", "cap", "Cap", "cringe", "Cringe", "NOPERS", "weirdchamp", "???", "HUH", "huh"]

INTENT_WEIGHTS = {"AMUSEMENT": 0.8, "HYPE": 0.9, "DISBELIEF": -0.3, "DISGUST_CRINGE": -0.7, "AGREEMENT": 0.6, "HEART_WARM": 0.9, "QUESTION": 0.0, "NEUTRAL": 0.0}
INTENTS = {
    "AMUSEMENT": ["lul", "lulw", "kekw", "omegalul", "icant", "lmao", "lmfao", "dying", "haha", "hahaha", "lol", "rofl", "hehe", "pepega"],
    "HYPE": ["pog", "pogchamp", "poggers", "pogbones", "letsgo", "w", "clip", "hypers", "insane", "clutch", "holy", "goat", "ez", "clap"],
    "DISBELIEF": ["huh", "cap", "fake", "noshot", "surely", "aintnoway", "what", "whaaat", "fr", "sus", "monkaw", "monkas"],
    "DISGUST_CRINGE": ["cringe", "weirdchamp", "aware", "despair", "wutface", "dansgame", "ew", "gross", "yikes", "nopers", "l"],
    "AGREEMENT": ["true", "based", "facts", "real", "gigachad", "nodders", "agree", "+1", "yep", "frfr"],
    "HEART_WARM": ["biblethump", "feelsstrongman", "widepeepohappy", "wholesome", "peepohappy", "feelsgoodman", "love", "heart", "<3"],
    "QUESTION": ["why", "how", "who", "where", "when", "explain", "lore"],
}

BOT_NAMES = ["nightbot", "streamelements", "moobot", "fossabot", "soundalerts", "wizebot"]
BOT_OPENINGS = "^(welcome to the stream|follow the channel|join the discord|check out)"
HOSTILE_TOKENS = ["loser", "kill", "die", "ugly", "fake", "dox", "doxx", "hate", "unsub", "unsubbed", "nobody cares", "irrelevant", "stfu"]
BANTER_TOKENS = ["trash", "washed", "throw", "threw", "cringe", "bald", "greasy", "omegalul", "kekw", "lul", "icant", "lmao", "bad"]
THREATS = ["doxx you", "kill yourself", "kys"]
ROASTS = ["bald", "greasy", "hairline", "washed"]
BACKLASH_TOKENS = ["sellout", "ad", "ads", "adw", "skip", "skipad", "cringe", "l", "sponsor", "adbreak"]
TOXIC_TERMS = ["hate", "scam", "fraud", "kys", "slur", "dox", "leak"]
PURCHASE_TRIGGERS = ["code", "bought", "buying", "ordered", "discount", "link", "coupon", "checkout", "worth"]
POSITIVE_CHAT = ["w", "pog", "love", "good", "great", "huge"]
SPEECH_POSITIVE = ["good", "great", "awesome", "amazing", "based", "true", "agree", "love", "incredible", "correct", "perfect", "w", "win", "fire"]
SPEECH_NEGATIVE = ["bad", "terrible", "awful", "trash", "cringe", "fake", "cap", "disagree", "horrible", "wrong", "hate", "l", "loss", "cooked"]

OPINIONS = [
    ("(liked|really liked|loved|enjoyed|super good|amazing|masterpiece|best)", "APPROVAL", 0.8),
    ("(hate|hated|terrible|awful|garbage|trash|worst|cooked|bad)", "DISAPPROVAL", -0.8),
    ("(okay|decent|mid|average|fine|not bad)", "NEUTRAL", 0.1),
]
ATTRIBUTES = [
    ("special effects", "special_effects"), ("cgi", "special_effects"), ("vfx", "special_effects"), ("graphics", "graphics"),
    ("gameplay", "gameplay"), ("combat", "gameplay"), ("story", "story"), ("plot", "story"), ("ending", "story"),
    ("soundtrack", "soundtrack"), ("music", "soundtrack"), ("performance", "performance"), ("fps", "performance"),
    ("movie", "overall_verdict"), ("film", "overall_verdict"), ("game", "overall_verdict"),
]
NO_SUBJECT = ["i", "the", "a", "this", "it"]

LEAK_CARD = r"\b(?:\d{4}[ -]?){3}\d{4}\b"
LEAK_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LEAK_IP = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
LEAK_TOKEN = r"(?i)(?:Bearer\s+[A-Za-z0-9_\-\.]{20,}|token=[A-Za-z0-9_\-\.]{16,})"

CONTRADICTION = ["false", "hoax", "debunked", "denied", "not true", "refuted", "rumor", "fake", "incorrect"]
OUTDATED = ["outdated", "previously", "former", "reversed", "superseded", "no longer"]
CONFIRMATION = ["confirmed", "announced", "official", "released", "stated", "verified", "true"]
KILLFEED = ["defeated", "killed", "slain", "headshot", "eliminated", "downed"]
SITES = ["x.com", "twitter.com", "reddit.com", "youtube.com", "ign.com", "twitch.tv"]

ENTITIES = {
    "GAME": {
        "World of Warcraft": [r"\bwow\b", r"\bworld of warcraft\b", r"\bgrim batol\b", r"\bazeroth\b", r"\bwar within\b"],
        "Elden Ring": [r"\belden ring\b", r"\berdtree\b", r"\bmalenia\b", r"\bshadow of the erdtree\b"],
        "Black Myth Wukong": [r"\bwukong\b", r"\bblack myth\b"],
        "Grand Theft Auto VI": [r"\bgta\s?6\b", r"\bgta\s?vi\b", r"\bgrand theft auto\b"],
        "Path of Exile": [r"\bpoe\b", r"\bpath of exile\b", r"\bpoe\s?2\b"],
        "Final Fantasy XIV": [r"\bffxiv\b", r"\bfinal fantasy\b", r"\bdawntrail\b"],
        "League of Legends": [r"\bleague\b", r"\blol\b", r"\bleague of legends\b"],
        "Diablo IV": [r"\bdiablo\b", r"\bdiablo\s?4\b", r"\bvessel of hatred\b"],
    },
    "CREATOR": {
        "Asmongold": [r"\basmon\b", r"\basmongold\b", r"\bzack\b", r"\bzackrawrr\b"],
        "xQc": [r"\bxqc\b", r"\bthe juicer\b"],
        "HasanAbi": [r"\bhasan\b", r"\bhasanabi\b"],
        "Kai Cenat": [r"\bkai\b", r"\bkai cenat\b"],
        "Shroud": [r"\bshroud\b"],
        "PewDiePie": [r"\bpewdiepie\b"],
    },
    "COMPANY": {
        "Blizzard": [r"\bblizzard\b", r"\bactivision\b"],
        "Valve": [r"\bvalve\b", r"\bsteam\b", r"\bgabe\b", r"\bgaben\b"],
        "Twitch": [r"\btwitch\b", r"\btwitchtv\b"],
        "YouTube": [r"\byoutube\b", r"\byt\b"],
        "Sony": [r"\bsony\b", r"\bplaystation\b", r"\bps5\b"],
        "Microsoft": [r"\bmicrosoft\b", r"\bxbox\b"],
        "Ubisoft": [r"\bubisoft\b"],
        "EA": [r"\bea\b", r"\belectronic arts\b"],
    },
    "TOPIC": {
        "Account Ban / Moderation": [r"\bban\b", r"\bbanned\b", r"\bunbanned\b", r"\bsuspension\b", r"\btos\b"],
        "Microtransactions / P2W": [r"\bcash shop\b", r"\bmicrotransaction\b", r"\bp2w\b", r"\bpay to win\b", r"\bbattle pass\b"],
        "Game Balance / Patch": [r"\bpatch\b", r"\bupdate\b", r"\bnerf\b", r"\bbuff\b", r"\bhotfix\b"],
        "Game Release / Beta": [r"\bbeta\b", r"\brelease\b", r"\btrailer\b", r"\bdemo\b", r"\blaunch\b"],
        "Industry Drama": [r"\bdrama\b", r"\blawsuit\b", r"\blayoffs\b", r"\bcontroversy\b"],
    },
}
