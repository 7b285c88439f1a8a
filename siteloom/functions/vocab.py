"""Vocabularies and constants of the rules. Results depend on them; replace a list to suit another kind of site."""

# Endings of paths that are no pages.
BINARY_EXTENSIONS = (
    "jpg jpeg png gif webp svg ico pdf doc docx xls xlsx ppt pptx zip rar 7z gz tar mp3 wav flac mp4 mov avi mkv css js map woff woff2 ttf eot"
).split()

# Paths that lead a crawl astray: whole path, beginning, inside, end.
NOISE_EQUAL = ("/webbkarta", "/wp-admin", "/wp-login.php")
NOISE_START = ("/webbkarta/", "/wp-admin/", "/wp-json/")
NOISE_INSIDE = ("/nyhetsarkiv/", "/driftinformation")
NOISE_END = ("/rss",)

# Path tokens of dated or article-like pages.
ARTICLE_TOKENS = ("nyhet", "nyheter", "huvudnyheter", "servicemeddelanden", "evenemang", "kalender", "artikel", "press", "arkiv", "aktuellt", "blogg")

# Last path segments that stand for the start page.
START_ALIASES = ("index.html", "index.htm", "startsida", "start", "home")

UTILITY_TOKENS = (
    "kontakt", "tillganglighet", "tillgaenglighet", "accessibility", "press", "grafisk", "intranat", "intranet", "admin", "logga in", "logga-in",
    "login", "ticket", "e post", "epost", "e-post", "webbplatsen", "om webbplatsen", "om-webbplatsen", "medarbetare", "for medarbetare",
    "for-medarbetare", "cookie", "cookies", "kakor", "om kakor", "gdpr", "integritet", "webbkarta", "sitemap", "tillganglighetsredogorelse",
)
ERROR_TOKENS = ("sidan hittades inte", "page not found", "404", "error", "psidata", "ticket server", "system", "sok", "search")
MICROSITE_TOKENS = ("badrike", "ystad gymnasium", "gymnasium", "industrifastigheter", "industrifastighet", "for elever", "for-elever", "elevportal", "skolportal", "portal")
MICROSITE_ENDINGS = ("gymnasiet", "gymnasium")
NEWS_ROOT_TOKENS = ("nyhet", "nyheter", "huvudnyheter", "evenemang", "event", "kalender", "aktuellt", "servicemeddelanden", "service meddelanden", "drift", "driftsinformation", "kampanj", "pressmeddelande")
NEWS_TITLE_TOKENS = ("sommarlov", "lov i ", "premiar", "pris", "prisas", "schema", "kungorelse", "beviljade bygglov", "grannehorande", "flyttade fordon", "subvention for trygghetsboende")
NOTICEBOARD = "anslagstavla"

# Topics of a site's top level: name and tokens. One token found adds TOPIC_ONE, several add TOPIC_MORE.
TOPICS = {
    "education": ("barn", "utbildning", "skola", "forskola"),
    "care_support": ("omsorg", "stod", "hjalp", "aldre", "familj"),
    "experience": ("uppleva", "gora", "kultur", "fritid", "bibliotek"),
    "building_environment": ("bygga", "bo", "miljo", "bostad"),
    "traffic": ("trafik", "resor", "gator", "infrastruktur"),
    "business_work": ("jobb", "foretag", "naringsliv", "arbete", "arbetsmarknad"),
    "municipality_politics": ("kommun", "politik", "demokrati"),
    "community_development": ("samhallsutveckling", "utveckling"),
}
TOPIC_ONE, TOPIC_MORE, ROOT_THRESHOLD = 0.28, 0.45, 0.55

# Content types in order of precedence: tokens of the path, tokens of the first heading.
CONTENT_PATH = {
    "doc": ("dokument", "blankett", "/pdf"),
    "search": ("search", "/sok", "/s%c3%b6k", "hitta"),
    "event": ("event", "evenemang", "kalender", "aktivitet"),
    "news": ("nyhet", "nyheter", "news", "pressrelease", "artikel"),
    "archive": ("arkiv", "archive"),
    "contact": ("kontakt", "contact"),
    "listing": ("lista", "listing"),
}
CONTENT_HEADING = {
    "doc": ("dokument", "blankett"),
    "search": ("sök", "sok", "search", "hitta"),
    "event": ("event", "evenemang", "kalender"),
    "news": ("nyhet", "nyheter", "news"),
    "archive": ("arkiv", "archive"),
    "contact": ("kontakt", "contact"),
}

# Content systems in order: name, signs in the lower-cased page, sign in the generator tag, signs needed, signs for high confidence.
CMS_RULES = (
    ("WordPress", ("/wp-content/", "/wp-includes/", "wp-json"), "wordpress", 1, 2),
    ("SiteVision", ("/sitevision/", "svdocready", "appregistry", "sv-template-", "sv-portlet", 'class="sv-'), None, 2, 4),
    ("Drupal", ("drupalsettings", "drupal.settings", "/sites/default/files/", "data-drupal-"), "drupal", 1, 2),
    ("Umbraco", ("/umbraco/", "umbraco", "uskinned", "umb-"), "umbraco", 2, 3),
    ("Optimizely", ("episerver", "optimizely", "data-epi", " epi-"), None, 2, 3),
    ("Sitecore", ("/sitecore/", "sitecore", " sc-"), None, 2, 3),
)

# Beginnings and parts of body classes that tell the template of a page.
CLASS_STARTS = ("sv-", "wp-", "page-template", "umb-", "epi-", "drupal-", "node-type-")
CLASS_PARTS = ("template", "page-", "layout", "content-type", "post-type")

# Letters with marks and what they fold to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz"

# Weights of evidence: name, weight if so, weight if not, in order of summing.
HOMEPAGE_WEIGHTS = (
    ("same_host", 0.18, -0.55), ("in_main", 0.16, -0.28), ("in_card", 0.14, 0.0), ("one_segment", 0.16, -0.14), ("good_title", 0.16, -0.18),
    ("siblings", 0.14, 0.0), ("not_utility", 0.08, -0.34), ("not_article", 0.08, -0.26), ("not_binary", 0.05, -0.45), ("visible", 0.05, -0.24),
)
SYNTHETIC_WEIGHTS = (
    ("prefix_unknown", 0.12, -0.7), ("two_children", 0.28, -0.35), ("referenced", 0.2, 0.0), ("not_dated", 0.18, -0.45), ("not_binary", 0.12, -0.45),
    ("not_utility", 0.1, -0.35), ("no_cycle", 0.18, -0.8), ("shallow", 0.08, -0.2), ("ancestor_known", 0.08, 0.0), ("deep_root_children", 0.1, 0.0),
)
PARENT_WEIGHTS = (
    ("ancestor_found", 0.35, -0.55), ("descends", 0.28, -0.5), ("not_root", 0.12, -0.15), ("structural", 0.14, 0.0), ("parent_not_article", 0.1, -0.25),
    ("no_cycle", 0.16, -0.8), ("two_segments", 0.08, -0.12), ("child_not_utility", 0.05, -0.18),
)
HOMEPAGE_THRESHOLD, HOMEPAGE_CAP, SYNTHETIC_THRESHOLD, SLUG_PENALTY, PARENT_THRESHOLD = 0.68, 0.62, 0.72, -0.55, 0.60

# Compared metrics: name, whether lower is bad, share from which a change is a regression.
COMPARED_METRICS = (
    ("flatPageCount", True, 0.10), ("treeNodeCount", True, 0.15), ("navGroupCount", True, 0.20), ("visibleGroupCount", True, 0.20),
    ("orphanPageCount", False, 0.20), ("duplicateUrlCount", False, 0.20), ("duplicateTitleCount", False, 0.20), ("failedVisitCount", False, 0.20),
    ("timeoutCount", False, 0.30), ("snapshotFailCount", False, 0.20), ("textExtractFailCount", False, 0.20), ("pagesCaptured", True, 0.10),
    ("emptyTitleCount", False, 0.20),
)

# Words of addresses that have lost their marks, and how they are written.
SLUG_REPAIRS = (("stod", "stöd"), ("gora", "göra"), ("miljo", "miljö"), ("hallbar", "hållbar"), ("naring", "näring"), ("omsorg", "omsorg"))
# Part of a path of service notices: where the whole section is noise, and where only its articles are.
NOTICE_SECTION, NOTICE_ARTICLE = "/driftinformation", "/driftinformation/"
