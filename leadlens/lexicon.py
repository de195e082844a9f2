"""Word lists, patterns and thresholds used by the text operators.

Everything here is data.  The tuples, maps and patterns are FIXED VALUES: results only match the
published behaviour when they are equal to it, so they are stated plainly and in their natural order.
A caller that works on another vocabulary passes its own :class:`Lexicon`.

Patterns use Java regex syntax.  ``(?iU)`` gives Unicode case folding and Unicode character classes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# ---------------------------------------------------------------- fixed values: URL and host handling
URL_PATTERN = r"(?iU)https?://[^\s<>\"')\]]+"
URL_TRAILING = ".,);"
SKIP_HOSTS = (
    "t.me", "youtube.com", "www.youtube.com", "youtu.be", "discord.gg", "discord.com", "github.com",
    "gist.github.com", "raw.githubusercontent.com", "drive.google.com", "tinyurl.com", "bit.ly",
)
MULTI_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.co", "com.cn", "com.br", "com.au", "co.kr", "co.jp", "co.in",
    "com.tr", "com.mx", "com.ar", "pp.ua", "co.il", "com.sg", "com.hk",
)
BLOCKED_DOMAINS = (
    "reddit.com", "github.com", "githubusercontent.com", "x.com", "twitter.com", "youtube.com", "youtu.be",
    "medium.com", "t.me", "telegram.me", "telegram.org", "facebook.com", "fb.com", "linkedin.com",
    "instagram.com", "tiktok.com", "news.ycombinator.com", "ycombinator.com", "discord.com", "discord.gg",
    "stackoverflow.com", "quora.com", "wikipedia.org", "archive.org", "bit.ly", "goo.gl", "notion.so",
    "substack.com", "wordpress.com", "blogspot.com", "gitlab.com", "bitbucket.org", "npmjs.com", "pypi.org",
    "huggingface.co", "github.io", "gitbook.io", "gitbook.com", "readthedocs.io", "readthedocs.org",
    "netlify.app", "vercel.app", "pages.dev", "web.app", "firebaseapp.com", "herokuapp.com", "surge.sh",
    "glitch.me", "repl.co", "ebay.com", "aliexpress.com", "alibaba.com", "taobao.com", "walmart.com",
    "etsy.com", "wildberries.ru", "ozon.ru", "avito.ru", "hackernoon.com", "dev.to", "hashnode.com",
    "hashnode.dev", "beehiiv.com", "ghost.io", "mirror.xyz", "filestack.com", "uploadcare.com",
    "cloudinary.com", "imgix.com", "mailchimp.com", "convertkit.com",
)
BARE_DOMAIN_PATTERN = (
    r"(?iU)(?<!@)\b((?:[a-z0-9]{2}[a-z0-9-]{0,60}[a-z0-9]\.)+"
    r"(?:ai|io|com|net|org|dev|app|co|in|xyz|gg|sh|me|cloud|tech|so|chat|run|top|pro|cc))\b"
)
HARVEST_HINT_PATTERN = (
    r"(?iU)\b(ai|llm|api|gpt|claude|gemini|deepseek|qwen|glm|kimi|grok|llama|mistral|model|tokens?|credits?|"
    r"free|trial|promo|voucher|coupon|tier)\b|ключ|кредит|бесплат|триал|промокод|额度|免费|注册送|中转"
)
NEAR_OFFER_PATTERN = (
    r"(?iU)\b(free|trial|promo|voucher|coupon|credits?|discount|offer|bonus|gift|\$\d)\b"
    r"|注册送|免费|额度|бесплатн|кредит|триал"
)
NEAR_OFFER_WINDOW = 100

# ---------------------------------------------------------------- fixed values: pre-filter
ZH_STRONG = (
    "注册送", "公益站", "中转站", "免费api", "白嫖", "送额度", "送余额", "送刀", "免费额度", "注册即送", "新用户送",
)
ZH_WEAK = ("免费", "额度", "中转")
RU_KEYWORDS = (
    "триал", "кредит", "бесплатн", "api ключ", "апи ключ", "регистрац", "раздач", "раздают", "баланс", "халяв",
    "промокод", "бонус",
)
EN_STRONG = (
    "free credit", "free credits", "free trial", "free api", "free tier", "api trial", "no credit card",
    "no card required", "sign up free", "register for free", "free access", "free tokens", "free quota",
    "get free", "claim free", "free plan includes", "promo code", "coupon code", "discount code", "use code",
    "free pro", "pro for free", "pro plan free", "get it free", "access for free", "free with",
)
EN_WEAK = (
    "credits", "sign up", "signup", "register", "redeem", "promo", "referral", "invite", "api key", "trial", "$",
)
MONEY_PATTERN = r"(?iU)\$\s?\d+|¥\d+|\d+\s*(?:刀|美元|баллов|credits?|tokens?)\b"
MONEY_TAG = "$money"

# ---------------------------------------------------------------- fixed values: rule classifier
MODEL_KEYWORDS = (
    "claude", "opus", "sonnet", "haiku", "gpt", "o1", "o3", "gemini", "glm", "deepseek", "qwen", "mistral",
    "llama", "grok",
)
AMOUNT_PATTERNS = (
    r"(?U)\$\s?(\d+(?:[.,]\d+)?)",
    r"(?U)(\d+(?:[.,]\d+)?)\s*(?:刀|美元)",
    r"(?iU)(\d+(?:[.,]\d+)?)\s*(?:баллов|кредит\w*|credits?)",
)
USD_WORDS = ("刀", "美元")
REFERRAL_PATTERN = r"(?iU)[?&](ref|invite|aff|promo|campaignId)=|referral|реф[- ]?ссылк|invite"
RELAY_WORDS = ("中转", "公益站", "注册送")
RELEASE_WORDS = ("huggingface", "model release", "релиз модел")
STAR_WORDS = ("star", "звезд")
REPO_WORDS = ("github", "репозитор")
HARD_WORDS = (
    "карта", "card", "b1n", "bin", "namso", "namso-gen", "генератор карт", "виртуальн", "vpn", "vps", "впн",
    "отменить", "cancel subscription", "пробный период", "refund", "fake card", "фейк", "chargeback",
)
MEDIUM_WORDS = (
    "ref=", "invite=", "реф-ссылк", "реферальн", "referral", "звезд", "github star", "star on github",
    "репозитор", "промокод", "promo code", "coupon", "business email", "бизнес почт", ".edu", "edu email",
)
FREEBIE_WORDS = (
    "vds", "vps", "vpn", "хостинг", "hosting", "сервер", "server", "домен", "domain", "ssl", "диск", "storage",
    "облак", "cloud credit", "free tier", "бесплатн", "халяв", "промокод", "promo code", "coupon", "купон",
    "скидк",
)
FREEBIE_TYPES = ("saas_promo", "grant")
UNIT_PATTERNS = (
    ("credits", r"(?U)\d+\s*(?:кредит|credit|балл|баллов|points?|cr\b)"),
    ("days", r"(?U)\d+\s*(?:дн|day|суток)"),
    ("months", r"(?U)\d+\s*(?:месяц|month|мес\b)"),
)
CARD_WORDS = (
    "credit card", "debit card", "debit", "card required", "card", "карта", "карту", "картой", "виза", "visa",
    "mastercard", "信用卡", "银行卡", "绑卡",
)
NO_CARD_PATTERN = (
    r"(?iU)no\s+(?:credit\s+|debit\s+)?card|without\s+(?:a\s+)?card|no\s+cc\b|card[-\s]?free|"
    r"no\s+payment\s+(?:method|required)|без\s+карт|не\s+(?:нужн\w*|требу\w*|надо)\s+карт|"
    r"无需(?:信用卡|绑卡)|不需要(?:信用卡|绑卡)|免绑卡|免信用卡"
)
PHONE_WORDS = (
    "phone verification", "phone number", "phone", "sms", "verify by sms", "телефон", "смс", "номер телефона",
    "手机", "短信", "手机号", "手机验证",
)
NEW_USER_WORDS = (
    "new users", "new user", "new account", "new accounts", "first deposit", "только новые",
    "новым пользоват", "新用户", "首充", "首次充值", "新注册",
)
REGION_RULES = (
    ("US-only", ("us only", "us-only", "сша только")),
    ("EU-only", ("eu only", "eu-only")),
    ("CN-only", ("cn only", "cn-only", "china only")),
    ("region-restricted", ("region", "only available in")),
)
RISK_RULES = (
    ("vpn", ("vpn", "впн")),
    ("fake_card", ("fake card", "namso", "bin", "b1n", "генератор карт", "виртуальн")),
    ("cancel_subscription", ("cancel subscription", "отменить", "cancel the subscription")),
    ("chargeback", ("chargeback", "refund", "возврат")),
)
REFERRAL_RISK_WORDS = ("referral", "ref=", "invite", "реф")
RISK_FLAGS = ("vpn", "fake_card", "cancel_subscription", "chargeback", "referral")
OFFER_TYPES = ("relay", "saas_trial", "saas_promo", "model_release", "grant", "abuse", "other")
EFFORTS = ("easy", "medium", "hard")
UNITS = ("usd", "credits", "days", "months")
TOPICS = ("ai_service", "freebie")
MAX_PLAUSIBLE_USD = {"saas_trial": 1000.0, "relay": 1000.0}
MIN_CONFIDENCE = 0.4
RELABEL_AMOUNT_CAP = 5000.0

# ---------------------------------------------------------------- fixed values: page facts
PAGE_MODEL_TOKENS = (
    ("claude", "claude"), ("opus", "opus"), ("sonnet", "sonnet"), ("haiku", "haiku"), ("gpt-5", "gpt"),
    ("gpt-4", "gpt"), ("gpt4", "gpt"), ("openai", "gpt"), ("gemini", "gemini"), ("deepseek", "deepseek"),
    ("grok", "grok"), ("llama", "llama"), ("qwen", "qwen"), ("mistral", "mistral"), ("kimi", "kimi"),
)
PAGE_MODEL_BOUNDED = (("gpt", "gpt"), ("o1", "gpt"), ("o3", "gpt"), ("glm", "glm"))
PAGE_AMOUNT_PATTERNS = (
    r"(?U)\$\s?(\d{1,3}(?:[,\s]?\d{3})*(?:\.\d+)?)",
    r"(?iU)(\d{2,6})\s*(?:credits?|刀|额度|points?|баллов)",
)
PAGE_AMOUNT_TRIGGERS = (
    "free", "credit", "trial", "bonus", "gift", "voucher", "sign up", "signup", "get $", "claim", "注册送",
    "免费", "送", "额度", "赠", "бесплатн", "кредит", "триал",
)
PAGE_AMOUNT_RANGE = (1.0, 5000.0)
PAGE_AMOUNT_WINDOW = 40
ENGINE_TITLES = {"new api": "new-api", "one api": "one-api", "sub2api": "sub2api"}
ENGINE_MARKS = (
    ("new-api", ("new-api", "newapi", "calcium-ion")),
    ("one-api", ("one-api", "songquanpeng")),
    ("sub2api", ("sub2api", "sub-2-api")),
    ("cliproxyapi", ("cliproxyapi", "cli-proxy-api")),
)
PRICING_TRIGGERS = (
    "free credit", "free trial", "no credit card", "no card", "$", "注册送", "免费", "trial", "credits", "送额度",
)
OFFER_PATHS_PRIMARY = ("/pricing", "/plans")
OFFER_PATHS_SECONDARY = ("/billing", "/subscribe", "/redeem")
RELAY_STATUS_PATH = "/api/status"
RELAY_MODELS_PATH = "/v1/models"
RELAY_NOTICE_PATH = "/api/notice"
OFFER_URL_PATTERN = r"(?i)pricing|plans|billing|subscribe|redeem|promo|coupon|trial|credits|free"
# A page's description, the name before the content and after it.
META_DESCRIPTION_PATTERNS = (
    r"(?is)<meta[^>]+(?:name|property)\s*=\s*[\"'](?:description|og:description)[\"'][^>]*"
    r"content\s*=\s*[\"'](.*?)[\"']",
    r"(?is)<meta[^>]+content\s*=\s*[\"'](.*?)[\"'][^>]*"
    r"(?:name|property)\s*=\s*[\"'](?:description|og:description)[\"']",
)

# ---------------------------------------------------------------- fixed values: certificate names
CT_KEYWORDS = (
    "router", "-api", "api-", "gateway", "relay", "llm", "gpt", "claude", "gemini", "aiproxy", "proxy", "oneapi",
    "one-api", "newapi", "new-api", "token", "freemodel", "chatapi", "aihub", "aigc", "openai", "anthropic",
    "deepseek", "qwen", "glm", "aiapi", "modelapi",
)
CT_DENY = ("apigee", "gateway.fb", "googleapis", "api.telegram")
HARVEST_TLDS = (
    ".ai", ".io", ".app", ".dev", ".so", ".run", ".cloud", ".bot", ".chat", ".tools", ".build", ".tech",
)
SUBDOMAIN_SIGNALS = (
    "api.", "console.", "dashboard.", "studio.", "playground.", "billing.", "developer.", "developers.",
)

# ---------------------------------------------------------------- fixed values: scoring
EASE_BY_TYPE = {
    "saas_trial": 1.0, "model_release": 0.9, "relay": 0.8, "saas_promo": 0.7, "grant": 0.6, "other": 0.5,
    "abuse": 0.3,
}
EASE_DEFAULT = 0.5
REFERRAL_EASE_FACTOR = 0.85
HALF_LIFE_HOURS = 60.0
QUALITY_FLOOR = 0.35
EARLY_BOOST = 0.1
CROSS_SOURCE_STEP = 0.15
CROSS_SOURCE_MAX = 3
AMOUNT_CAP = 200.0
SOURCE_LANG = {
    "forum_rss": "zh", "nodeseek": "zh", "linux.do": "zh", "bilibili": "zh", "csdn": "zh", "weibo": "zh",
    "telegram": "ru", "twitter-ru": "ru", "reddit": "en", "hackernews": "en", "producthunt": "en",
}
AGGREGATOR_SOURCES = ("telegram", "telegram_ingest")

# ---------------------------------------------------------------- fixed values: candidate queue
RETRY_HOURS = (1.0, 6.0, 24.0)
UNSAFE_SUFFIXES = (".local", ".internal", ".lan", ".localdomain")
LINKGRAPH_PATHS = ("/", "/models", "/providers", "/docs")

# ---------------------------------------------------------------- fixed values: feed views
TAB_FILTERS = {
    "all": {}, "easy": {"effort": "easy"}, "medium": {"effort": "medium"}, "hard": {"effort": "hard"},
    "dead": {"status": "dead"}, "saved": {},
}
SOURCE_CATEGORIES = {
    "forums": (
        "forum_rss", "nodeseek", "linux.do", "linuxdo", "linuxdo_top", "v2ex", "hostloc", "reddit", "hackernews",
        "hackernews_ai", "hackernews_show", "bilibili_search_api", "bilibili_search_relay", "zhihu_topic_api",
        "csdn_search", "juejin_tag_ai", "weibo_search", "discord_dir",
    ),
    "github": ("github", "github_lists", "github_issues", "github_code"),
    "telegram": ("telegram", "telegram_ingest"),
    "youtube": ("youtube",),
    "producthunt": ("producthunt", "betalist", "ph_upcoming"),
    "catalogs": (
        "directories", "coupon", "openrouter", "packages", "fofa", "leaks", "appsumo", "saasworthy",
        "futurelist", "uneed", "yc", "provider_lists", "changelog", "appstore", "wellfound",
    ),
}

# ---------------------------------------------------------------- fixed values: redaction
KEY_LINE_PATTERN = (
    r"(?iU)(sk-[A-Za-z0-9\-_]{10,}|Bearer\s+[A-Za-z0-9\-_\.]{10,}|api[_-]?key\s*[=:]\s*\S{10,}|"
    r"Authorization\s*[=:]\s*\S{10,})"
)
SAFE_HOST_PATTERN = r"(?U)https?://([^\s\"'<>)\]/:]+)"
SAFE_HOST_SKIP = (
    "openai.com", "api.openai.com", "anthropic.com", "google.com", "googleapis.com", "huggingface.co",
    "github.com", "pastebin.com", "gist.github.com", "raw.githubusercontent.com", "localhost", "example.com",
    "127.0.0.1",
)
SNIPPET_TITLE_PATTERN = r"(?iU)\b(openai|base_url|llm|claude|chatgpt|gemini|relay|中转|api.key|sk-)\b"
SNIPPET_EXTENSIONS = (".env", ".yaml", ".yml", ".txt", ".py", ".js", ".ts")
SNIPPET_KEYWORDS = ("base_url", "openai", "api", "llm", "relay", "中转")

# ---------------------------------------------------------------- fixed values: notification topics
TOPIC_AI, TOPIC_FREEBIE, TOPIC_FORWARDED = "ai_services", "freebies", "forwarded"
NOTIFY_MIN_SCORE = 0.6
NOTIFY_MIN_CONFIDENCE = 0.5
DEFAULT_INTERVAL = 900


@dataclass(frozen=True)
class Lexicon:
    """The overridable vocabulary; the defaults are the fixed values above."""

    zh_strong: tuple[str, ...] = ZH_STRONG
    zh_weak: tuple[str, ...] = ZH_WEAK
    ru: tuple[str, ...] = RU_KEYWORDS
    en_strong: tuple[str, ...] = EN_STRONG
    en_weak: tuple[str, ...] = EN_WEAK
    money_pattern: str = MONEY_PATTERN
    models: tuple[str, ...] = MODEL_KEYWORDS
    harvest_hint: str = HARVEST_HINT_PATTERN
    key_lines: str = KEY_LINE_PATTERN

    @classmethod
    def from_settings(cls, settings: dict[str, Any]) -> "Lexicon":
        """Overlay stored setting values (``prefilter_*`` keys) on the defaults; unknown keys are ignored."""
        keys = {
            "prefilter_zh_strong": "zh_strong", "prefilter_zh_weak": "zh_weak", "prefilter_ru": "ru",
            "prefilter_en_strong": "en_strong", "prefilter_en_weak": "en_weak",
        }
        return replace(cls(), **{attr: tuple(settings[k]) for k, attr in keys.items() if k in settings})


@dataclass(frozen=True)
class ScoreWeights:
    """Quality weights and decay of the offer score (freshness acts through the decay only)."""

    amount: float = 0.3
    ease: float = 0.2
    reliability: float = 0.1
    half_life_hours: float = HALF_LIFE_HOURS
    early_boost: float = EARLY_BOOST
    amount_cap: float = AMOUNT_CAP
    source_lang: dict[str, str] = field(default_factory=lambda: dict(SOURCE_LANG))


SETTINGS_DEFAULTS: dict[str, Any] = {
    "prefilter_en_strong": list(EN_STRONG),
    "prefilter_en_weak": list(EN_WEAK),
    "prefilter_ru": list(RU_KEYWORDS),
    "prefilter_zh_strong": list(ZH_STRONG),
    "prefilter_zh_weak": list(ZH_WEAK),
    "score_w_freshness": 0.4,
    "score_w_amount": 0.3,
    "score_w_ease": 0.2,
    "score_w_reliability": 0.1,
    "early_signal_boost": EARLY_BOOST,
    "discovery_limit": 40,
    "notify_min_score": NOTIFY_MIN_SCORE,
}
