"""Ordered rule tables and dimensions: data without logic."""

from __future__ import annotations

# URL type -> (expected success, patterns); the first type with a matching pattern holds.
URL_TYPES: dict[str, tuple[float, list[str]]] = {
    "satellite": (0.93, ["/Satellite/notice/", "/Satellite/public/company/project/", "/VMPSatellite/notice/", "/VMPSatellite/public/company/project/", "/Vergabe/notice/", "/Vergabe/public/company/project/"]),
    "evergabe_deep": (0.05, [r"/evergabe\.bieter/api/supplier/external/deeplink/", "/bieter/api/supplier/external/deeplink/", r"evergabe\.bieter", r"evergabe\.nrw\.de/evergabe\.bieter", r"evergabe\.nrw\.de/bieter", r"evergabe\.bayern", r"vergabemarktplatz\.brandenburg", r"vergabe\.muenchen\.de/.*evergabe"]),
    "eva_portal": (0.05, [r"e-va\.eu", r"e-va\.de", r"/bundde\?data="]),
    "netserver_auth": (0.05, [r"/NetServer/TenderingProcedureDetails\?function=_Details", r"/NetServer/TenderingProcedureDetails\?function=_Tender", r"beschaffungen\.barmer\.de"]),
    "netserver_pub": (0.65, [r"/NetServer/PublicationControllerServlet\?function=Detail", r"/NetServer/PublicationControllerServlet\?function=GetDocumentFile", r"vergabe24\.de/NetServer/", r"tender24\.de/NetServer/"]),
    "subreport": (0.40, [r"subreport\.de", r"subreport-elvis\.de"]),
    "evergabe_web": (0.50, [r"evergabe-online\.de", r"evergabe\.de/"]),
    "ted_europa": (0.85, [r"ted\.europa\.eu", r"etendering\.ted\.europa\.eu", r"simap\.ted\.europa\.eu", r"eprocurement\.ted\.europa\.eu", r"enotices\.ted\.europa\.eu", r"enotices2\.ted\.europa\.eu"]),
    "uk_tender": (0.80, [r"find-tender\.service\.gov\.uk", r"contractsfinder\.service\.gov\.uk", r"procurementjourney\.scotland\.gov\.uk", r"sell2wales\.gov\.wales", r"etenderwales\.bravosolution\.co\.uk", r"procontract\.due-north\.com"]),
    "fr_place": (0.70, [r"marches-publics\.info", r"place\.gouv\.fr", r"boamp\.fr", r"aws\.achatpublic\.com", r"achatpublic\.com", r"megalis\.bretagne\.fr", r"klekoon\.com", r"atexo\.fr.*marche"]),
    "pl_miniportal": (0.70, [r"miniportal\.uzp\.gov\.pl", r"ezamowienia\.gov\.pl", r"przetargi\.pl", r"bzp\.uzp\.gov\.pl"]),
    "es_place": (0.70, [r"contrataciondelestado\.es", r"contratacion\.gob\.es", r"licitacion\.es", r"perfiles\.contratosdelsector\.es"]),
    "pt_base": (0.70, [r"base\.gov\.pt", r"acingov\.pt", r"ancp\.gov\.pt", r"vortal\.pt", r"sapoempresas\.pt.*concurso"]),
    "nl_tenderned": (0.80, [r"tenderned\.nl", r"tenderned\.com", r"negometrix\.com", r"aanbestedingskalender\.nl"]),
    "be_eprocure": (0.75, [r"eten\.be", r"publicprocurement\.be", r"jepp\.be", r"e-procurement\.be", r"bda-online\.be"]),
    "at_ausschreib": (0.70, [r"ausschreibungen\.at", r"bieterportal\.at", r"beschaffung\.gv\.at", r"bbg\.gv\.at"]),
    "ch_simap": (0.75, [r"simap\.ch", r"beschaffung\.admin\.ch", r"ausschreibungen\.admin\.ch", r"bkb\.admin\.ch"]),
    "it_proc": (0.60, [r"acquistinretepa\.it", "acquistinrete", r"consip\.it", "tuttogare", "appaltipubblici", r"serviziocontrattipubblici\.it"]),
    "ie_etenders": (0.70, [r"etenders\.gov\.ie", "irlgov.*etender"]),
    "nordic": (0.70, [r"doffin\.no", r"mercell\.com", r"e-avrop\.com", r"visma.*opic|opic\.com", r"kommers\.se", r"tendsign\.com", r"hankintailmoitukset\.fi", r"udbud\.dk|ethics\.dk"]),
    "eu_east": (0.60, [r"promitheus\.gov\.gr|eprocurement\.gov\.gr", r"nen\.nipez\.cz|tenderarena\.cz", r"kozbeszerzes\.hu|ekr\.gov\.hu", r"e-licitatie\.ro", r"uvo\.gov\.sk|eks\.sk", r"enarocanje\.si", r"eojn\.nn\.hr", r"eop\.bg|aop\.bg", r"riigihanked\.riik\.ee", r"eis\.gov\.lv", r"cvpp\.lt|vpt\.lt"]),
    "us_sam": (0.65, [r"sam\.gov", r"grants\.gov", r"fbo\.gov", r"acquisition\.gov", "unison.*marketplace", r"bonfirehub\.com"]),
    "ca_tenders": (0.65, [r"canadabuys\.canada\.ca", r"buyandsell\.gc\.ca", r"merx\.com", r"bidsandtenders\.ca", r"biddingo\.com", r"bcbid\.gov\.bc\.ca"]),
    "latam": (0.60, [r"comprasnet|gov\.br/compras|\.gov\.br.*licita|licitacoes-e", "compranet|comprasmx", r"mercadopublico\.cl", r"comprar\.gob\.ar|argentinacompra", r"colombiacompra|secop\.gov\.co", r"seace\.gob\.pe|perucompras"]),
    "in_gem": (0.60, [r"gem\.gov\.in", r"eprocure\.gov\.in", r"etenders?\.gov\.in", r"\.nic\.in.*tender", r"tenderwizard\.com"]),
    "asia_other": (0.45, [r"gebiz\.gov\.sg", r"njss\.info|geps\.go\.jp|p-portal\.go\.jp", r"ccgp\.gov\.cn|chinabidding", r"g2b\.go\.kr", r"eprocure.*gov\.(np|bd|pk|lk)"]),
    "africa": (0.55, [r"etenders\.gov\.za|etender.*\.gov\.za", r"tenders\.go\.ke", r"bpp\.gov\.ng|nocopo\.bpp\.gov\.ng", r"etenders\.gov\.eg", r"ghana.*tender|tender.*gov\.gh"]),
    "au_austender": (0.75, [r"tenders\.gov\.au", "austender", r"tenders\.nsw\.gov\.au", r"tenders\.vic\.gov\.au", r"qtenders|hpw\.qld\.gov\.au", r"tenders\.sa\.gov\.au|tenders\.wa\.gov\.au", r"etender.*\.gov\.au"]),
    "nz_gets": (0.75, [r"gets\.govt\.nz"]),
}
# Fixed value: expected success of all other types.
UNKNOWN_SUCCESS = 0.35

# Orders of strategies by URL type; the rest run the full cascade.
MINIMAL = ["existing", "cua", "manual"]
LLM_FIRST = ["existing", "llm_generated", "manual", "cua"]
MANUAL_FIRST = ["existing", "manual", "llm_generated", "cua"]
STRATEGY_ORDERS: dict[str, list[str]] = {
    "satellite": ["deterministic", "existing", "adaptive", "manual"],
    "netserver_pub": ["existing", "deterministic", "manual", "llm_generated", "cua"],
    "netserver_auth": MINIMAL,
    "eva_portal": MINIMAL,
    "evergabe_deep": MINIMAL,
    "subreport": ["existing", "manual", "llm_generated"],
    "evergabe_web": MANUAL_FIRST,
    "ted_europa": LLM_FIRST,
    **dict.fromkeys("uk_tender nl_tenderned be_eprocure ch_simap at_ausschreib ie_etenders nordic us_sam ca_tenders au_austender nz_gets".split(), LLM_FIRST),
    **dict.fromkeys("fr_place pl_miniportal es_place pt_base it_proc eu_east latam in_gem africa asia_other".split(), MANUAL_FIRST),
}
FULL_ORDER = ["existing", "deterministic", "llm_generated", "cua", "manual"]
FULL_ORDER_KNOWN_PLATFORM = ["deterministic", "existing", "llm_generated", "cua", "manual"]
# Platforms with the second full order.
KNOWN_PLATFORMS = ["dtvp", "netserver"]

# Platforms by URL pattern, first match.
PLATFORMS: dict[str, list[str]] = {
    "dtvp": ["/Satellite/public/company/project/", "/VMPSatellite/public/company/project/", "/Satellite/notice/", "/VMPSatellite/notice/", "/Vergabe/notice/", "/Vergabe/public/company/project/"],
    "netserver": ["/NetServer/"],
    "evergabe_cosinex": [r"/evergabe\.bieter/api/supplier/external/deeplink/", "/bieter/api/supplier/external/deeplink/", r"evergabe\.bieter", r"evergabe\.nrw", r"evergabe\.bayern", r"vergabemarktplatz\.brandenburg", r"vergabe\.muenchen"],
    "e_va": [r"e-va\.eu", r"/bundde\?data="],
    "evergabe_de": [r"www\.evergabe\.de"],
    "evergabe_online": [r"evergabe-online\.de"],
    "ted_eu": [r"ted\.europa\.eu", r"enotices\.ted\.europa\.eu"],
    "negometrix": [r"negometrix\.com", r"negometrix\.nl"],
    "mercell": [r"mercell\.com"],
    "subreport": [r"subreport\.de", r"subreport-elvis\.de"],
    "deutsche_evergabe": [r"deutsche-evergabe\.de", r"bieterzugang\.deutsche-evergabe\.de"],
    "bi_medien": [r"bi-medien\.de", r"deutsches-ausschreibungsblatt\.de"],
    "vergabe24": [r"vergabe24\.de"],
    "sharepoint": [r"\.sharepoint\.com/:f:/"],
    "ariba": [r"eu\.mu\.ariba\.com"],
}

# Error category -> pattern, first match.
ERROR_CATEGORIES: dict[str, str] = {
    "timeout": r"timeout|timed out|deadline exceeded|read timed out",
    "network": r"connection (refused|reset|closed|error)|ECONNREFUSED|ECONNRESET|broken pipe",
    "dns": r"dns|name resolution|getaddrinfo|name or service not known",
    "ssl": r"ssl|certificate|tls|handshake|self.?signed",
    "redirect_loop": r"redirect.?(loop|limit|too many|max)|too many redirects",
    "encoding_error": r"encod|decode|codec|unicode|charmap|utf.?8",
    "code_validation": r"validation failed|forbidden (import|call)|missing required function",
    "prompt_injection": r"prompt.?inject|injection detected",
    "blocked_url": r"url not allowed|scheme|private network|ssrf",
    "sandbox": r"sandbox|memory limit|killed|oom",
    "login_required": r"login.?(required|form|page|redirect)|anmeld|registrier|bitte.?(anmelden|registrieren)|sign.?in required|muss.*angemeldet|please log in|account required",
    "registration_required": r"registrierung (erforderlich|notwendig|ben.tigt)|registration required|konto erstellen|create.?account|nur.*(registriert|angemeld)",
    "auth": r"(401|403)\b|unauthorized|access denied|forbidden",
    "captcha": r"captcha|recaptcha|hcaptcha|bot.?detection|cloudflare|ddos-guard|cf-ray",
    "not_found": r"404|not found|page not found",
    "rate_limit": r"429|rate.?limit|too many requests",
    "server_error": r"5\d{2}|server error|internal server|502|503|504|bad gateway|service unavailable",
    "expired": r"archiviert|archiv(ed|ierung)|abgelaufen|nicht (mehr )?verf.?gbar|vergabeverfahren.*(beendet|abgeschlossen)|tender.*(expired|closed|ended)|ausschreibung.*(beendet|abgelaufen)|frist.*abgelaufen",
    "maintenance": r"wartung|maintenance|under construction|site.?down|gewartet",
    "js_required": r"js.?required|javascript.?(required|enabled|needed)|script.?error|noscript",
    "empty_page": r"empty.?page|page is empty|no content|blank page|keine (inhalte|daten)",
    "scraper_crash": r"traceback|unhandled exception|scraper produced no result|crashed|exit code [^0]",
    "no_documents": r"no.?(files|documents|valid)|html_content|too_small",
    "storage": r"persist failed|s3|storage|upload",
    "no_strategy": r"no template|not deterministic|no runner",
    "loop_exhausted": r"loop exhausted|max.?iterations?",
}
# Risk -> categories; the rest is low.
RISKS = {"high": ["prompt_injection", "blocked_url"], "moderate": ["timeout", "network", "code_validation"]}

# Outcome bucket -> (label, suggested action, categories).
BUCKETS: dict[str, tuple[str, str | None, list[str]]] = {
    "success": ("Succeeded", None, []),
    "auth_gated": ("Login / registration required", "Log in or register on the portal (or supply credentials), then retry this URL.", ["login_required", "registration_required", "auth"]),
    "captcha": ("CAPTCHA / bot block", "Open the URL in a real browser, clear the CAPTCHA/bot check, then retry.", ["captcha"]),
    "expired": ("Expired or not found", "Verify the tender is still open; the documents may have been removed.", ["expired", "not_found"]),
    "unreachable": ("Unreachable (network / server)", "Transient site/network issue — retry later (the circuit breaker will reopen).", ["timeout", "network", "dns", "ssl", "redirect_loop", "server_error", "rate_limit", "maintenance", "circuit_open"]),
    "no_documents": ("No documents found", "Confirm documents are actually published on this page; the link may be a listing.", ["no_documents", "empty_page", "js_required", "no_strategy"]),
    "blocked": ("Blocked (security)", "Review the URL — it was blocked by SSRF/security guards.", ["blocked_url", "prompt_injection"]),
    "error": ("Error — needs investigation", "Inspect the error detail and audit trail for this item.", ["code_validation", "sandbox", "scraper_crash", "loop_exhausted", "storage", "encoding_error", "unknown"]),
}
# Buckets that a person can resolve.
MANUAL_BUCKETS = ["auth_gated", "captcha"]

# Injection patterns in untrusted content.
INJECTIONS: list[str] = [
    r"ignore (all )?previous (instructions|prompts)",
    r"disregard (all )?(previous |prior |above )?(instructions|prompts|rules)",
    r"\bsystem\s+prompt\b[\s:]*(is|was|says|=|:)\s*[\"'`]",
    r"<\s*system\s*>",
    r"\bjailbreak\b",
    r"reveal (your|the) (instructions|system prompt)",
    r"you are now an? (unrestricted|uncensored|evil|different|new) (ai|assistant|model|bot)",
    r"act as (an? )?(different|new|unrestricted|uncensored) (ai|assistant|model|bot)",
    r"\b(curl|wget)\b.*\b(api.?key|secret|token|password)\b",
    r"base64\.b64(encode|decode)",
    r"(?:\\x[0-9a-f]{2}){3,}",
    r"---+\s*\n\s*(system|assistant|user)\s*:",
    r"(?s)<\s*script[^>]*>.*?\b(eval|exec)\s*\(",
]
# Hosts that are not public.
PRIVATE_NETS = [r"^127\.", r"^10\.", r"^192\.168\.", r"^172\.(1[6-9]|2[0-9]|3[0-1])\.", r"^169\.254\.", r"^0\.", r"^localhost$", r"^::1$"]

# All strategies.
STRATEGIES = ["existing", "deterministic", "adaptive", "llm_generated", "learned_route", "cua", "manual", "none"]

# What each category says to people.
REASONS: dict[str, str] = {
    "timeout": "Request timed out — portal too slow or overloaded",
    "network": "Network error — connection refused or reset by portal",
    "dns": "DNS resolution failed — domain does not exist",
    "ssl": "SSL/TLS error — certificate problem on portal",
    "redirect_loop": "Redirect loop detected — URL keeps redirecting indefinitely",
    "encoding_error": "Encoding/decode error — response could not be read (charset issue)",
    "code_validation": "Generated scraper failed validation — unsafe or wrong signature",
    "prompt_injection": "Prompt injection pattern detected in URL or page content",
    "blocked_url": "URL blocked — private network or disallowed scheme (SSRF protection)",
    "sandbox": "Sandbox resource limit exceeded — scraper used too much memory/CPU",
    "login_required": "Login required — portal shows a sign-in wall (no hard 401/403)",
    "registration_required": "Registration required — must create an account to access documents",
    "auth": "Access denied (HTTP 401/403) — portal requires authentication",
    "captcha": "CAPTCHA / bot detection triggered — Cloudflare or reCAPTCHA blocked access",
    "not_found": "Page not found (HTTP 404) — URL may be expired or removed",
    "rate_limit": "Rate limited (HTTP 429) — too many requests to portal",
    "server_error": "Portal server error (5xx) — backend issue on the tender site",
    "expired": "Tender expired or archived — documents no longer publicly available",
    "maintenance": "Site under maintenance — try again later",
    "js_required": "JavaScript required — page needs browser rendering, plain HTTP failed",
    "empty_page": "Empty/blank page — portal loaded but returned no usable content",
    "scraper_crash": "Scraper crashed — unhandled exception in generated or stored scraper code",
    "no_documents": "No downloadable documents found on the page",
    "storage": "File storage error — could not save to S3/MinIO",
    "no_strategy": "No matching strategy — deterministic template does not apply",
    "loop_exhausted": "LLM feedback loop exhausted — all iterations failed to produce valid scraper",
    "unknown": "Unexpected error — check error_raw for details",
}
