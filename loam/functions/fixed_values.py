"""Lists that results depend on, stated as they are."""

# Query parameters that only track, on any site (fixed values).
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic",
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "twclid", "mc_cid", "mc_eid", "igshid", "_ga", "_gl",
]

# Query parameters that only track on sites that start with the key (fixed values).
SITE_TRACKING_PARAMS = {
    "youtube.com": ["si", "app", "feature", "persist_app", "pp", "t", "kw", "origin"],
    "youtu.be": ["si", "t", "feature"],
    "google.": ["ved", "ei", "sclient", "referrer"],
    "aliexpress.": ["spm", "scm"],
    "amazon.": ["ref_"],
    "imdb.com": ["ref_"],
}

# Public suffixes of two labels (fixed values).
TWO_LEVEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "com.mx", "co.in", "com.cn", "or.jp"]

# Hosts that are blocked from the start (fixed values).
BLOCKED_HOSTS = [
    "pinterest.com", "pinterest.co.uk", "pin.it", "facebook.com", "fb.com", "instagram.com", "threads.net", "twitter.com", "x.com", "t.co",
    "linkedin.com", "tiktok.com", "snapchat.com", "quora.com", "slideshare.net", "scribd.com", "fandom.com", "wattpad.com",
    "google.com", "googleapis.com", "gstatic.com", "googleusercontent.com", "wikidata.org", "wikimedia.org", "000webhostapp.com", "weebly.com", "tripod.com",
]

# Wiki families of which only some language editions are followed (fixed values).
WIKI_FAMILIES = ["wikipedia.org", "wiktionary.org", "wikiquote.org", "wikivoyage.org", "wikibooks.org", "wikisource.org"]
WIKI_EDITIONS = ["en", "simple", "www"]

# Wiki namespaces, file types and path fragments that are not followed (fixed values).
WIKI_NAMESPACES = ["File:", "Special:", "Talk:", "User:", "User_talk:", "Template:", "Help:", "Wikipedia:", "MediaWiki:", "Draft:", "Module:", "TimedText:", "WP:"]
SKIPPED_EXTENSIONS = [
    ".pdf", ".zip", ".gz", ".tgz", ".tar", ".exe", ".dmg", ".iso", ".mp3", ".mp4", ".avi", ".mkv", ".png", ".jpg", ".jpeg", ".gif", ".webp",
    ".svg", ".ico", ".woff", ".woff2", ".ttf", ".css", ".js", ".xml", ".rss", ".atom", ".opml", ".ics",
]
SKIPPED_FRAGMENTS = ["/wp-admin", "/wp-login", "/cgi-bin/", "/checkout", "/cart", "/logout", "/signin", "/signup", "/register", "/cdn-cgi/"]
TRAP_FRAGMENTS = ["/nepenthes", "/iocaine", "/labyrinth", "/tarpit", "/honeypot", "/spidertrap", "/crawlertrap"]
SESSION_PARAMS = ["sessionid", "phpsessid", "jsessionid", "sid"]
COPY_PARAMS = ["print", "share"]

# Parts of paths whose pages are followed and not indexed (fixed values).
HUB_NAMESPACES = ["Portal:", "Category:"]
LISTING_SEGMENTS = ["tag", "category", "author", "page"]
AUTH_SEGMENTS = ["login", "signin", "sign-in", "logout", "oauth", "oauth2", "openid", "sso", "register", "signup", "cart", "checkout"]
PROFILE_SEGMENTS = ["members", "member", "users", "user", "u"]

# Hosts by kind (fixed values): equal, or with the given ending.
MEDIA_HOSTS = ["youtube.com", "youtu.be", "m.youtube.com", "odysee.com"]
MEDIA_ENDINGS = [".odysee.com"]
WIKI_HOSTS = ["wiki.archlinux.org", "wiki.debian.org", "wiki.gentoo.org", "wiki.nixos.org", "minecraft.wiki", "pcgamingwiki.com"]
WIKI_ENDINGS = [
    "wikipedia.org", "wiktionary.org", "wikibooks.org", "wikisource.org", "wikiversity.org", "wikivoyage.org", "wikinews.org", "wikiquote.org", "wikimedia.org", ".wiki", "wiki.gg",
]
FORUM_FRAGMENTS = ["/forum", "/viewtopic", "/viewforum", "/showthread", "/thread", "/t/", "/discussion"]

# Weights of hosts, the first tier that has a host counts (fixed values).
HOST_TIERS = [
    (1.4, [
        "wikipedia.org", "wiktionary.org", "wikibooks.org", "wikisource.org", "wikiversity.org", "wikivoyage.org", "wikiquote.org", "mozilla.org", "developer.mozilla.org",
        "archlinux.org", "debian.org", "wiki.debian.org", "gentoo.org", "nixos.org", "kernel.org", "gnu.org", "ietf.org", "rfc-editor.org", "w3.org", "man7.org", "archive.org",
    ]),
    (1.3, [
        "rust-lang.org", "doc.rust-lang.org", "docs.rs", "python.org", "docs.python.org", "nodejs.org", "apache.org", "nginx.org", "postgresql.org", "mysql.com", "sqlite.org",
        "go.dev", "pkg.go.dev", "crates.io", "pypi.org", "npmjs.com", "cppreference.com", "learn.microsoft.com", "readthedocs.io", "ziglang.org", "llvm.org", "kotlinlang.org",
        "haskell.org", "elixir-lang.org", "clojure.org", "ruby-lang.org", "perl.org", "php.net", "openjdk.org", "docker.com", "kubernetes.io", "manpages.debian.org", "devdocs.io",
        "mdn.org", "firefox.com", "stackoverflow.com", "stackexchange.com", "serverfault.com", "superuser.com", "askubuntu.com",
    ]),
    (1.25, ["wiki.gg", "minecraft.wiki", "pcgamingwiki.com", "strategywiki.org", "tcrf.net"]),
    (1.2, ["github.com", "gitlab.com", "codeberg.org", "sr.ht", "sourcehut.org", "git.kernel.org", "bitbucket.org"]),
    (1.1, ["youtube.com", "odysee.com", "peertube"]),
    (0.65, [
        "medium.com", "quora.com", "pinterest.com", "forbes.com", "businessinsider.com", "buzzfeed.com", "hubpages.com", "ehow.com", "livestrong.com", "w3schools.com",
        "geeksforgeeks.org", "tutorialspoint.com", "javatpoint.com", "chegg.com", "coursehero.com", "studypool.com", "answers.com", "wikihow.com", "investopedia.com",
        "healthline.com", "verywellmind.com", "verywellhealth.com", "webmd.com", "cnet.com", "zdnet.com", "tomsguide.com", "tomshardware.com", "techradar.com", "livescience.com",
        "space.com", "gamesradar.com", "pcgamer.com", "ign.com", "gamespot.com", "polygon.com", "screenrant.com", "gamerant.com", "cbr.com", "thegamer.com", "fandom.com",
        "breezometer.com", "weather.com", "accuweather.com", "msn.com", "yahoo.com", "aol.com", "nypost.com", "dailymail.co.uk", "the-sun.com", "thesun.co.uk", "mirror.co.uk",
        "express.co.uk", "reddit.com",
    ]),
]

# Titles of walls and failures, by phrase or as a whole (fixed values).
JUNK_PHRASES = [
    "just a moment", "access denied", "attention required", "403 forbidden", "404 not found", "503 service", "verify you are human", "checking your browser",
    "one moment please", "please wait", "captcha", "enable javascript", "pardon our interruption", "rate limited", "are you a robot", "unusual traffic",
]
AUTH_TITLES = ["sign in", "log in", "login", "signin", "sign up", "create account"]

# English words that real prose has many of (fixed values).
FUNCTION_WORDS = ["the", "of", "and", "to", "a", "in", "is", "it", "for", "on", "with", "as", "that", "this", "be", "are", "was", "by", "or", "from", "at", "an", "not", "have", "has"]

# Search: words of queries about the present, title words of bait, and words without sense (fixed values).
NEWS_WORDS = [
    "news", "latest", "breaking", "today", "yesterday", "tonight", "announced", "launch", "release", "deadline", "update", "election", "results", "score", "weather", "forecast", "stock", "price",
]
BAIT_WORDS = ["best", "top 10", "top 5", "review", "reviews", "buy", "cheap", "discount", "coupon", "deal", "deals", "vs", "alternatives", "2025", "2026", "2027"]
BAIT_SEPARATORS = [" - ", " | ", ": ", "·"]
SENSELESS_WORDS = [
    "the", "this", "that", "with", "from", "your", "what", "when", "where", "which", "about", "how", "why", "and", "for", "guide", "best", "top", "review", "reviews", "new",
    "2024", "2025", "2026", "page", "site", "website", "home",
]
NAVIGATION_DOMAINS = ["com", "org", "net", "io", "dev", "app", "network", "co", "gg", "tv"]
FIELDS = ["url", "host", "title", "body", "description", "fetched_at", "authority", "inlinks", "kind"]

# JSON-LD kinds whose headline and description count (fixed values).
JSON_LD_KINDS = [
    "Article", "NewsArticle", "BlogPosting", "WebPage", "TechArticle", "VideoObject", "SocialMediaPosting", "DiscussionForumPosting", "QAPage", "FAQPage",
]

# Parts of pages that are no text (fixed values): tags, classes by tag, classes, ids, roles.
DROPPED_TAGS = ["script", "style", "noscript", "template", "iframe", "svg", "nav", "footer", "header", "form", "aside", "dialog"]
DROPPED_TAG_CLASSES = [("table", "infobox"), ("table", "navbox"), ("table", "sidebar"), ("sup", "reference"), ("ol", "references")]
DROPPED_CLASSES = [
    "mw-editsection", "noprint", "mw-jump-link", "hatnote", "dablink", "cookie-banner", "consent-banner", "gdpr-banner", "advertisement", "adsbygoogle",
]
DROPPED_IDS = ["mw-navigation", "mw-panel", "siteNotice", "jump-to-nav", "cookie-consent"]
DROPPED_ROLES = ["navigation", "banner", "contentinfo"]
TEXT_LEADS = ["Jump to content ", "Jump to navigation ", "From Wikipedia, the free encyclopedia "]

# Marks of challenge pages (fixed values).
PROOF_OF_WORK_MARKS = ["window.__anubis_challenge__", "Making sure you're not a bot"]
EDGE_MARKS = ["cf-chl", "challenge-platform", "Just a moment"]
