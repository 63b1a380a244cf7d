"""Constants that decide results and therefore must not vary."""

from __future__ import annotations

# -- Fixed values: message that marks an access-log line ----------------------
ACCESS_MESSAGE = "handled request"

# -- Fixed values: where a line says its time, in Unix seconds ------------------
LINE_TIME = r'"ts"\s*:\s*([0-9]+(?:\.[0-9]+)?)'

# -- Fixed values: registered TLS protocol and cipher-suite numbers ------------
TLS_VERSIONS = {
    769: "TLS 1.0",
    770: "TLS 1.1",
    771: "TLS 1.2",
    772: "TLS 1.3",
}
TLS_CIPHERS = {
    4865: "TLS_AES_128_GCM_SHA256",
    4866: "TLS_AES_256_GCM_SHA384",
    4867: "TLS_CHACHA20_POLY1305_SHA256",
    49195: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    49196: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    49199: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    49200: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    52392: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305",
    52393: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305",
}

# -- Fixed values: length of each text column where it is cut for display ---------------------------
FIELD_LENGTHS = {
    "method": 10,
    "uri": 4096,
    "path": 2048,
    "query": 2048,
    "protocol": 10,
    "user_agent": 512,
    "referer": 512,
    "referer_domain": 128,
    "tls_alpn": 10,
    "http_proto": 10,
    "logger_id": 20,
    "logger_name": 64,
}

# -- Fixed values: user-agent words of scanners, bad bots and all bots/tools -----
SCANNER_WORDS = (
    "nikto", "nessus", "sqlmap", "masscan", "zgrab", "nuclei", "nmap",
    "dirbuster", "gobuster", "wfuzz", "hydra", "medusa", "metasploit",
    "burpsuite", "acunetix", "netsparker", "appscan", "w3af", "skipfish",
    "whatweb", "httprint", "fimap", "commix", "dalfox", "jaeles",
    "feroxbuster", "ffuf", "dirb",
)
BAD_BOT_WORDS = (
    "ahrefsbot", "semrushbot", "dotbot", "majestic", "mj12bot", "petalbot",
    "yandexbot", "baiduspider", "ia_archiver",
)
BOT_WORDS = (
    *SCANNER_WORDS,
    "subfinder", "amass", "crawl", "spider", "python-requests", "go-http-client", "curl/", "wget/", "libwww", "lwp-",
    "scrapy", "mechanize", *BAD_BOT_WORDS, "duckduckbot", "facebookexternalhit", "twitterbot", "linkedinbot", "slackbot",
)

# -- Fixed values: attack patterns searched in the lower-cased URI -----------------
SQL_INJECTION_PATTERN = (
    r"(union\s+select|select\s+.*\s+from|insert\s+into|drop\s+table|"
    r"'\s*or\s+'1'\s*=\s*'1|--\s*$|;\s*--|\bexec\s*\(|"
    r"xp_cmdshell|0x[0-9a-f]{4,}|char\(\d+\)\s*\+)"
)
XSS_PATTERN = (
    r"(<script[^>]*>|javascript:|on\w+\s*=|<img[^>]+src\s*=\s*['\"]?javascript|"
    r"eval\s*\(|document\.cookie|alert\s*\(|<iframe[^>]*>)"
)
TRAVERSAL_PATTERN = r"(\.\./|\.\.\\|%2e%2e|%252e%252e|\x00|%00)"
LOGIN_PATHS = ("/login", "/auth", "/signin", "/wp-login")
ABUSED_METHODS = ("TRACE", "CONNECT")

# -- Fixed values: threat score weights --------------------------------------------
BOT_SCORE = 40
EMPTY_AGENT_SCORE = 15
PROBE_STATUS_SCORE = 5
PROBE_STATUSES = (400, 401, 403, 404, 405, 429)
MAX_SCORE = 100

# -- Fixed values: named periods -> (look-back minutes, bucket, chart hint) ------------
PERIODS = {
    "l15m": (15, "1 minute", "minute"),
    "l1h": (60, "1 minute", "minute"),
    "l6h": (360, "15 minutes", "15min"),
    "l24h": (1440, "1 hour", "hour"),
    "l7d": (10080, "8 hours", "8hour"),
    "l30d": (43200, "1 day", "day"),
}
DEFAULT_PERIOD = "l24h"

# -- Fixed values: report vocabularies ---------------------------------------------------
SORTABLE_COLUMNS = (
    "ts", "host", "remote_ip", "method", "status", "duration_ms",
    "response_bytes", "country_code",
)
PAGE_COLUMNS = (
    "id", "ts", "host", "remote_ip", "method", "uri", "path", "status",
    "duration_ms", "response_bytes", "request_bytes", "user_agent",
    "ua_browser", "ua_os", "ua_device", "country_code", "country_name",
    "city", "referer", "tls_version", "http_proto", "is_bot", "threat_score",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
HEAT_STEPS = (0.12, 0.25, 0.45, 0.65, 0.82)
