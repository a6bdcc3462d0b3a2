"""Word lists, selectors, patterns and formats that results depend on.

Everything below is data. The values have to be exactly these for results to be
right; no logic lives here.
"""

# --- indicator types -------------------------------------------------------
# Order matters: it breaks ties between candidates with the same span.
TYPE_ORDER = (
    "url", "email", "file", "domain", "cve", "ipv4", "md5", "sha1", "sha256",
    "apt_group_mention", "country_mention",
)
PRIMARY_TYPES = ("ipv4", "domain", "md5", "sha256", "file", "email")
ALL_PRIMARY_TYPES = PRIMARY_TYPES + ("sha1", "url")
MENTION_TYPES = ("cve", "country_mention", "apt_group_mention")

# --- file extensions recognised in text ------------------------------------
FILE_EXTENSIONS = (
    "exe", "dll", "sys", "bat", "ps1", "sh", "py", "js", "png", "jpg", "jpeg", "gif", "bmp",
    "tiff", "svg", "pdf", "txt", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar",
    "7z", "tar", "gz", "iso", "img", "cer", "pem", "key", "csr", "html", "htm", "css", "json",
    "xml", "yaml", "yml", "query", "log", "bak", "tmp", "temp", "cfg", "ini", "conf",
)

# --- words around a hit that mark it as harmless ---------------------------
HARMLESS_PHRASES = (
    "for example", "e.g.", "such as", "like", "sample", "example of", "visit",
    "download from", "protect against", "how to", "tutorial", "documentation",
    "legitimate site", "benign", "harmless", "looks like", "as shown below",
    "in the image", "the following command", "demonstrates", "illustrates",
)

# --- default whitelist ------------------------------------------------------
WHITELIST = {
    "domains": (
        "virustotal.com", "snort.org", "talosintelligence.com", "microsoft.com",
        "phishing.com", "google.com", "apple.com", "github.com", "gitlab.com", "asp.net",
        "twitter.com", "linkedin.com", "facebook.com", "www.salesforce.com", "docker.io",
        "github.com", "cmd.exe", "www.bsi.bund.de", "claude.ai", "cline.bot", "bi.zone",
    ),
    "ips": (
        "1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "0.0.0.0", "127.0.0.1", "8.11.4.27",
    ),
    "files": (
        "node.js", "cmd.exe", "mcp.json", "package.json", "AsIO3.sys", "PowerShell.exe",
    ),
    "emails": (),
    "md5": (),
    "sha1": (),
    "sha256": (),
}
# Which whitelist a type is checked against and reported into.
WHITELIST_KIND = {
    "domain": "domains", "url": "domains", "ipv4": "ips", "file": "files",
    "email": "emails", "md5": "md5", "sha1": "sha1", "sha256": "sha256",
}

# --- IPv4 ranges that are private, loopback, unspecified or reserved ---------
NON_ROUTABLE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
NON_ROUTABLE_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")

# --- page structure -----------------------------------------------------------
ARTICLE_CONTAINERS = (
    "div.articlebody", "div.article-body", "div.story-content", "div.post-body",
    "div#article-content", "div.td-post-content",
)
SEMANTIC_CONTAINERS = ("article", "main")
KEYWORD_CONTAINER_TAGS = ("div", "section")
CONTAINER_KEYWORDS = ("article", "content", "post", "news", "story", "main", "body")
BOILERPLATE = (
    "script", "style", "form", "nav", "footer", "header", ".ad", ".advertisement",
    ".author-box", ".related-posts", ".share", ".tags", ".cf.note-b",
)
TEXT_BLOCKS = ("h1", "h2", "h3", "h4", "p", "li", "pre", "code", "table")
LINK_AREAS = (
    "article", "main", "div#main-col", "div.bc_latest_news", "div#content", "div.content",
    "div#main", "div.main-content", "div.posts", "div.body-post", "section.post-content",
    "a.story-link",
)
MIN_ARTICLE_CHARS = 50

# --- article links --------------------------------------------------------------
# Regular expressions searched in the link path.
LINK_BLACKLIST = (
    "/search", "/tag/", "/author/", "/login", "/signup", "/forums", "/forum/", "/legal/",
    "/glossary/", "/news-tip/", "mailto:", "tel:", "/about", "/offer/", "/deals/", "/deals",
    "/categories",
)
DEFAULT_LINK_KEYWORDS = ("/offer/", "/deals/")
MIN_LINK_SCORE = 3
RESCAN_DAYS = 5
REFRESH_DAYS = 7

# --- enrichment -------------------------------------------------------------------
SNIPPET_CHARS = 50
PROXIMITY_CHARS = 250

# --- country names rewritten on load ----------------------------------------------
COUNTRY_EXACT = {
    "congo, the democratic republic of the": "DR Congo",
    "congo, republic of the": "Republic of the Congo",
    "korea, republic of": "South Korea",
    "korea, democratic people's republic of": "North Korea",
}
COUNTRY_CONTAINS = {
    "virgin islands, british": "British Virgin Islands",
    "virgin islands, u.s.": "U.S. Virgin Islands",
}

# --- file names -------------------------------------------------------------------
FILENAME_WORDS = {
    "://": "_protocol_", ":": "_colon_", "/": "_slash_", "\\": "_backslash_",
    "*": "_star_", "?": "_question_", "<": "_lt_", ">": "_gt_", "|": "_pipe_",
    '"': "_quote_",
}
FILENAME_DEFAULT = "default_ioc_name"
FILENAME_CHARS = 100

# --- exports ----------------------------------------------------------------------
CSV_COLUMNS = (
    "ioc_value", "ioc_type", "discovery_timestamp", "occurrence_count",
    "source_article_urls", "first_seen_context_snippet", "associated_cves",
    "associated_countries", "associated_apts", "normalized_apts",
)
STIX_VERSION = "2.1"
# Namespace of the deterministic UUIDv5 ids of cyber-observables (public STIX 2.1 text).
STIX_NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
