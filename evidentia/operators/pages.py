"""Web pages: signals from platform fingerprints, structure, content, credentials, appearance and signs of human work.

prepare() computes the shared inputs of all rules once per page; hits() gives one row per page and signal. Rules are
native expressions: most count how many of a list of patterns match one of the inputs. They are evaluated in groups, in
projections of their own, so that no generated method grows too large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bundles as B
from ..functions.guards import fold, led, seen, words as words_of
from ..functions.text import declared_language, has_emoji, once, visible_text, word_count

#: Characters of page and assets that rules of appearance look at.
SCAN = 786_432
THIN_BYTES = 1500

# Patterns. (input, patterns, how many must match)
FINGERPRINTS = {
    "fp.lovable": [r"(?i)cdn\.gpteng\.co", r"(?i)gptengineer\.js", r"(?i)/lovable-uploads/", r"(?i)lovable-tagger", r"(?i)\.lovable\.(?:app|dev)", r"(?i)Edit with Lovable", r"(?i)/__l5e/|~flock\.js", r"(?i)\bdata-lov(?:able)?-(?:id|name)=", r"(?i)lovable\.dev/opengraph-image", r"(?i)Lovable Generated Project"],
    "fp.bolt": [r"(?i)Made in Bolt", r"(?i)\.bolt\.host", r"(?i)bolt\.new", r"(?i)stackblitz\.com/"],
    "fp.v0": [r"(?i)Built with v0", r"(?i)v0\.dev|v0\.app", r"(?i)v0-[a-z0-9-]+\.vercel\.app", r"(?i)My v0 Project"],
    "fp.replit": [r"(?i)replit-badge|replit\.com/badge", r"(?i)\.repl\.co|\.replit\.(?:app|dev)", r"(?i)replit-dev-banner|__replco"],
    "fp.base44": [r"(?i)@base44/sdk", r"(?i)\.base44\.app"],
}
HOSTS = {"fp.lovable": r"(?i)\.lovable\.app$", "fp.bolt": r"(?i)\.bolt\.host$", "fp.base44": r"(?i)\.base44\.app$", "fp.replit": r"(?i)\.(?:replit\.app|repl\.co)$"}
BUILDERS = {
    "Rocket": r"(?i)rocket\.new|rocket-?builder",
    "Create.xyz": r"(?i)create\.xyz|createxyz",
    "Tempo Labs": r"(?i)tempolabs\.ai|tempo-?labs",
    "Databutton": r"(?i)databutton\.com|databutton-app",
    "Emergent": r"(?i)emergent\.sh|emergentagent",
    "Firebase Studio": r"(?i)idx\.google\.com|firebase-?studio",
    "Builder.io": r"(?i)builder\.io/c/|visual-?copilot",
    "Anima": r"(?i)animaapp\.com|anima-?generated",
    "Locofy": r"(?i)locofy\.ai|locofy-?generated",
    "Dora": r"(?i)dora\.run|dorabuilder",
    "Durable": r"(?i)durable\.co/site|durablesites",
    "Mocha": r"(?i)getmocha\.com|mocha-?app",
}
GENERATOR = r"(?i)<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)[\"']"
GENERATOR_NAMES = r"(?i)lovable|bolt|v0|base44|replit|dualite|softr|create\.xyz|tempo|famous\.ai|gpt|claude|copilot|cursor"
TITLE = r"(?i)^(?:vite\s*\+\s*(?:react|vue|svelte|preact|lit|solid)(?:\s*\+\s*(?:ts|js))?|vite app|react app|create react app|next app|create next app|next\.js app|nuxt app|my app|my v0 project|v0 app|sveltekit app|document|untitled|untitled document|index)$"
DESCRIPTION = r"(?i)^(?:generated by create next app|web site created using create-react-app|vite\s*\+|lovable generated project|created with bolt|my v0 project|a new .{0,20}app|astro description)"
SCAFFOLD = [r"(?i)<link[^>]+href=[\"']/?(?:vite|next|nuxt|astro|svelte)\.svg[\"']", r"(?i)You need to enable JavaScript to run this app"]
STACK = [r"(?i)@radix-ui|data-radix-|radix-ui/react", r"(?i)class-variance-authority|cva\(\s*['\"]", r"(?i)tailwind-merge|twMerge", r"(?i)\bclsx\b", r"(?i)lucide-react|\blucide\b", r"(?i)\bsonner\b|react-hot-toast|<Toaster|useToast", r"(?i)\bcmdk\b", r"(?i)\bvaul\b", r"(?i)embla-carousel", r"(?i)framer-motion|motion/react", r"(?i)react-hook-form", r"(?i)@tanstack/react-query"]
FRAMEWORKS = {
    "Next.js": r"(?i)__NEXT_DATA__|/_next/static|self\.__next_f",
    "Nuxt": r"(?i)/_nuxt/|__NUXT__",
    "Remix": r"(?i)__remixContext|/build/_shared/",
    "Astro": r"(?i)astro-island|/_astro/",
    "SvelteKit": r"(?i)__sveltekit_|/_app/immutable/",
    "Vite": r"(?i)/assets/index-[A-Za-z0-9_-]{6,}\.js|__vite__|/@vite/",
    "Create React App": r"(?i)/static/js/main\.[a-z0-9]{8}\.js",
}
HEAD_PARTS = [r"(?i)<meta[^>]+property=[\"']og:", r"(?i)<meta[^>]+name=[\"']twitter:", r"(?i)<meta[^>]+name=[\"']description", r"(?i)<link[^>]+rel=[\"']canonical", r"(?i)<meta[^>]+name=[\"']viewport", r"(?i)<link[^>]+rel=[\"'][^\"']*icon", r"(?i)application/ld\+json"]
SKIPPED_COMMENT = r"(?i)^\[if |Google Tag Manager|Google Analytics|End |Facebook Pixel|Hotjar|Cloudflare"
SECTION_COMMENT = r"(?i)^(?:=+|-+|\*+)?\s*(?:hero|header|nav(?:igation)?|features?|benefits?|how it works|testimonials?|pricing|faq|cta|call to action|footer|about|contact|stats|social proof|newsletter|gallery|team|services?|sections?)\s*(?:section|area|block|=+|-+|\*+)?\s*$"
PALETTE = ["#6366f1", "#615fff", "#4f46e5", "#818cf8", "#8b5cf6", "#8e51ff", "#7c3aed", "#a855f7", "#a78bfa", "#6d28d9", "#c084fc", "#0f172a", "#1e1b4b"]
PALETTE_CLASS = r"(?i)\b(?:bg|text|from|via|to|border|ring)-(?:indigo|violet|purple|fuchsia)-\d{2,3}\b"
GRADIENT = r"(?i)bg-gradient-to-\w+[^\"']*(?:indigo|violet|purple)|linear-gradient\([^)]*(?:#6366f1|#8b5cf6|#a855f7|rgb\(9[0-9],\s*9[0-9])"
FONTS = ["Inter", "Geist", "Poppins", "Space Grotesk", "Manrope", "Plus Jakarta Sans", "DM Sans"]
NAMES = ["John Smith", "Jane Doe", "John Doe", "Sarah Johnson", "Michael Brown", "Alex Miller", "Emily Davis", "David Wilson", "Jessica Williams", "Michael Chen", "Sarah Chen", "Emily Chen", "Alex Thompson", "Maria Garcia", "Jean Dupont", "Marie Martin", "Pierre Durand", "Sophie Bernard", "Juan Pérez", "María García", "Max Mustermann", "Erika Mustermann"]
TITLES = ["Verified User", "Head of Operations", "Product Manager at", "CEO, Company", "Satisfied Customer", "Happy Customer", "Founder & CEO", "Client satisfait", "Utilisateur vérifié", "Cliente satisfecho"]
CLICHES = {
    "en": ["ship faster", "unlock the power", "supercharge", "seamlessly", "effortlessly", "everything you need to", "get started in seconds", "loved by developers", "built for the modern", "take your .{3,20} to the next level", "game-?changer", "in just a few clicks", "without the guesswork", "trusted by thousands", "lightning[- ]fast", "blazing[- ]fast", "powerful yet simple", "say goodbye to", "streamline your workflow", "all[- ]in[- ]one platform", "designed for teams of all sizes"],
    "fr": ["boostez", "sans effort", "en toute simplicité", "tout ce dont vous avez besoin", "passez à la vitesse supérieure", "en quelques clics", "des milliers de clients", "la solution ultime", "révolutionnez", "gagnez du temps et de l'argent", "conçu pour les équipes", "dites adieu (?:à|aux)"],
    "es": ["impulsa tu", "sin esfuerzo", "todo lo que necesitas", "en pocos clics", "miles de clientes", "la solución definitiva", "lleva tu .{3,20} al siguiente nivel", "ahorra tiempo y dinero", "diseñado para equipos", "di adiós a"],
    "de": ["im handumdrehen", "mühelos", "alles, was sie brauchen", "in wenigen klicks", "tausende (?:von )?kunden", "die ultimative lösung", "bringen sie ihr .{3,20} auf das nächste level", "sparen sie zeit und geld", "entwickelt für teams"],
}
PLACEHOLDERS = ["lorem ipsum", "your text here", "placeholder text", "coming soon", "insert .{3,20} here", "sample text", "company name here", "texte ici", "votre texte", "contenu à venir", "bientôt disponible", "texto de ejemplo", "próximamente", "ihr text hier", "demnächst verfügbar"]
STATISTICS = [
    r"(?iu)\b(?:\d{1,3}(?:,\d{3})*|\d+)\s*(?:k|K|M|m)?\+\s*(?:happy\s+)?(?:users?|customers?|developers?|teams?|downloads?|companies|businesses|creators?|members?|clients?|utilisateurs?|usuarios?|kunden|nutzer)",
    r"(?iu)\b(?:99\.9+|9[5-9])\s*%\s*(?:uptime|accuracy|satisfaction|faster|reliable|de satisfaction|disponibilité|zufriedenheit)",
    r"(?iu)\b\d{1,3}x\s+(?:faster|better|more|cheaper|productive|plus rapide|más rápido|schneller)",
]
SOURCED = r"(?iu)\b(?:source|according to|survey|report|study|measured|benchmark|selon|étude|estudio|laut|studie)\b"
STARRED = r"(?iu)\b(?:most popular|recommended|best value|le plus populaire|recommandé|más popular|beliebteste)\b"
PRICED = r"(?iu)(?:\$|€|£)\s?\d{1,4}\s*(?:/|per\s|par\s)\s*(?:mo|month|user|seat|year|mois|utilisateur|an|monat)"
SPECIFICS = [
    r"[$£€]\s?\d{1,3}(?:[.,]\d{2})?|\d+\s?(?:€|EUR|USD|GBP)",
    r"(?i)\b\d{1,2}[:h]\d{2}\b|\b(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s*[-–]\s*(?:mon|tue|wed|thu|fri|sat|sun)",
    r"(?iu)\b\d{1,4}[,\s]+(?:rue|avenue|street|st\.|road|rd\.|boulevard|blvd|allée|impasse|chemin|calle|straße|strasse)\b",
    r"\b(?:\+\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?){2,4}\d{2,4}\b",
]
#: Patterns that are far cheaper than others and match wherever these do; digits and signs tell at once.
QUICK = dict(zip(SPECIFICS, [r"[$£€]\s?\d|\d\s?(?:€|EUR|USD|GBP)", r"(?i)[:h]\d\d|[-–]\s*(?:mon|tue|wed|thu|fri|sat|sun)", r"\d[,\s]", r"\d\d\)?[\s.-]?\(?\d\d"]))
FOUNDED = r"(?iu)\b(?:since|established|founded|depuis|est\.|desde|seit)\b"
MISSPELLINGS = {
    "en": ["recieve", "seperate", "occured", "definately", "accomodate", "adress", "buisness", "thier", "untill", "sucessful", "publically", "calender", "enviroment", "neccessary", "existance", "maintainance", "refered", "begining", "beleive", "wierd", "arguement", "foriegn", "goverment", "independant", "occurence", "persistant", "priviledge", "recomend", "tommorow", "wellcome", "succesful", "commited", "appologise", "garantee", "guarentee", "proffesional", "reccomend", "availabe", "concious", "embarass", "harrass", "noticable", "occassion", "perseverence", "questionaire", "rythm", "supercede", "threshhold", "writting", "usefull", "carefull", "succesfully"],
    "fr": ["acceuil", "addresse", "professionel", "developement", "developpeur", "malgrés", "parmis", "biensur", "quelquechose", "apparament", "entrainement", "evenement", "exhorbitant", "dilemne", "infractus", "aggrandir", "rénumération", "pallier à", "context", "exemple:"],
    "es": ["haber si", "a ver si vienes", "echo un vistazo", "aver", "osea", "enves de", "escusa", "abrigo de", "exhuberante", "idiosincracia"],
    "de": ["standart", "seperat", "wiederspiegeln", "aufwendig zu erreichen", "zumindestens", "einzigst", "reperatur", "authentisch aussehende"],
}
OPERATIONS = [
    r"(?i)cookie[- ]?(?:consent|banner|policy)|gdpr|tarteaucitron|cookieconsent|axeptio|didomi|usercentrics|osano|klaro",
    r"(?i)href=[\"'][^\"']*(?:privacy|terms|legal|mentions-legales|impressum|datenschutz|cgv|cgu|aviso-legal|politica-de-privacidad)",
    r"(?i)googletagmanager\.com|google-analytics\.com|gtag\(|plausible\.io|matomo|umami|fathom|hotjar|clarity\.ms|posthog",
    r"(?i)mailchimp|list-manage\.com|sendinblue|brevo|convertkit|substack|klaviyo|mailerlite",
]
CMS = {
    "WordPress": r"(?i)wp-content|wp-includes|wp-json",
    "Wix": r"(?i)static\.parastorage\.com|wix\.com|_wixCssStates",
    "Squarespace": r"(?i)squarespace\.com|static1\.squarespace",
    "Webflow": r"(?i)\.webflow\.io|webflow\.com/js",
    "Shopify": r"(?i)cdn\.shopify\.com|Shopify\.theme",
    "Drupal": r"(?i)/sites/default/files|Drupal\.settings",
    "Joomla": r"(?i)/media/system/js/|Joomla",
    "PrestaShop": r"prestashop|PrestaShop",
}
ANNOUNCE = r"(?iu)introducing|announcing|new\b|now (?:with|in|available)|just (?:launched|shipped)|v\d|coming soon|beta|early access|backed by|✨|🎉|🚀"
PILL = r"(?i)<(?:div|span|a|p)[^>]*class=[\"'][^\"']*\b(?:rounded-full|pill|badge|chip)\b[^\"']*[\"'][^>]*>\s*(?:<[^>]+>\s*){0,50}[^<]{3,60}</"
SESSION_COOKIE = r"(?i)\b(?:PHPSESSID|wordpress_|wp-settings|JSESSIONID|ASP\.NET_SessionId|laravel_session|_rails_session|django_session|symfony)\b"
PLATFORM_HEADERS = {"Vercel": ["x-vercel-id", "x-vercel-cache"], "Netlify": ["x-nf-request-id"], "Railway": ["x-railway-request-id"], "Render": ["x-render-origin-server"], "Fly.io": ["fly-request-id"], "Cloudflare": ["cf-ray"], "GitHub Pages": ["x-github-request-id"]}
SECURITY_HEADERS = ["content-security-policy", "strict-transport-security", "x-frame-options", "x-content-type-options", "permissions-policy", "referrer-policy"]
PHOTO, PIPELINE = r"(?i)\.(?:jpe?g|png|webp|avif|gif|heic)\b", r"(?i)/_next/image|/cdn-cgi/image/|/_vercel/image|res\.cloudinary\.com|\.imgix\.net|images\.unsplash\.com|\.imagekit\.io|/wp-content/uploads/"
HASHED_ASSET = r"(?i)\.(?:js|css)\?[a-z0-9=]+|-[A-Za-z0-9_]{8,}\.(?:js|css)"


#: The folded text (guards.fold) that has all of an input in it, by the input's name.
FOLDED = {"html": "fold_page", "hay": "fold_page", "blob": "fold_page", "markup": "fold_page", "copy": "fold_copy"}


def may_match(folded: str, pattern: str) -> Column | None:
    """Whether what is in a folded text may match a pattern; None if that can't be told."""
    return seen(F.col(folded), pattern, F.col("words_page") if folded == "fold_page" else None)


def like(s: Column | str, pattern: str, folded: str | None = None) -> Column:
    """Whether a pattern matches; inputs of prepare() by their names are searched for the pattern's plain texts first."""
    folded = folded or (FOLDED[s] if isinstance(s, str) else None)
    matched = (F.col(s) if isinstance(s, str) else s).rlike(led(pattern))
    may = may_match(folded, pattern) if folded else None
    if isinstance(s, str) and pattern in QUICK:
        matched = F.col(s).rlike(QUICK[pattern]) & matched
    return matched if may is None else may & matched


def any_of(s: Column | str, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [like(s, p) for p in patterns])


def how_many(s: Column | str, patterns: list[str], folded: str | None = None) -> Column:
    """How many of the patterns match."""
    return reduce(lambda a, b: a + b, [like(s, p, folded).cast("int") for p in patterns])


def matches(s: str, pattern: str) -> Column:
    may = may_match(FOLDED[s], pattern)
    n = F.regexp_count(s, F.lit(led(pattern)))
    return n if may is None else F.when(may, n).otherwise(0)


def all_of(s: str, pattern: str, group: int = 1) -> Column:
    may = may_match(FOLDED[s], pattern)
    found = F.regexp_extract_all(s, F.lit(led(pattern)), F.lit(group))
    return found if may is None else F.when(may, found).otherwise(F.array().cast("array<string>"))


def extract(s: str, pattern: str, group: int = 1) -> Column:
    may = may_match(FOLDED[s], pattern)
    found = F.regexp_extract(s, led(pattern), group)
    return found if may is None else F.when(may, found).otherwise("")


def first_of(s: Column, patterns: dict[str, str]) -> Column:
    """The name of the first pattern that matches, or null."""
    return F.coalesce(*[F.when(s.rlike(p), F.lit(name)) for name, p in patterns.items()])


#: Tasks for each core that costly rules are dealt to, so that no task is much longer than the others.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """df in several tasks for each core, if it has fewer: a file may be one partition, or a few large ones, and rules are costly."""
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def prepare(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, host, html, markup, hay, blob, copy, headers, ...): the inputs of the rules, and the columns to keep. A null page is empty.

    pages may have assets (map of address to body), headers (map of lower-case names) and source_maps (array of sources and
    content, see bundles.source_maps). markup is the page and the class lists of its bundles, copy its text and their
    sentences, hay the page and the names of what it loads.
    """
    has = set(pages.columns)
    empty = F.create_map().cast("map<string,string>")
    assets = F.coalesce(F.col("assets"), empty) if "assets" in has else empty
    headers = F.coalesce(F.col("headers"), empty) if "headers" in has else empty
    maps = F.coalesce(F.col("source_maps"), F.array().cast(B.MAPS)) if "source_maps" in has else F.array().cast(B.MAPS)
    rows = spread(pages).select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#:]+)", 1)).alias("host"), assets.alias("assets"), headers.alias("headers"), maps.alias("maps"), *keep)
    rows = rows.withColumn("hay", F.concat_ws("\n", "html", F.array_join(F.map_keys("assets"), "\n"), B.map_paths(F.col("maps"))))
    rows = rows.withColumn("blob", B.safe_cut(F.concat_ws("\n", "html", F.array_join(F.map_values("assets"), "\n")), SCAN)).withColumn("copy", visible_text(B.safe_cut(F.col("html"), SCAN)))
    size = F.octet_length("html")
    body = F.coalesce(F.octet_length(F.array_join(F.map_values("assets"), "")), F.lit(0))
    mapped = F.aggregate("maps", F.lit(0), lambda n, m: n + F.octet_length(m["content"]))
    rows = rows.withColumn("readable", size + body + mapped).withColumn("scan_cut", (size > SCAN) | (size + body > SCAN))
    if "assets" in has or "source_maps" in has:
        rows = rows.withColumn("bundles", B.readable_sources(F.col("assets"), F.col("maps"), SCAN)).withColumn("strings", B.harvest(F.col("bundles")))
        rows = rows.withColumn("markup", F.concat_ws("\n", "html", B.class_attributes(F.col("strings")))).withColumn("copy", F.concat_ws("\n", "copy", B.sentences(F.col("strings")))).drop("bundles", "strings")
        rows = rows.withColumn("minified", B.minified(F.col("assets")))
    else:
        rows = rows.withColumn("markup", F.col("html")).withColumn("minified", F.lit(False))
    rows = rows.withColumn("paths", B.map_paths(F.col("maps"))).withColumn("low_copy", F.lower("copy"))
    # all that hay, blob and markup may have: the page, and what comes with it
    loaded = [F.array_join(F.map_keys("assets"), "\n"), "paths", F.array_join(F.map_values("assets"), "\n")] if "assets" in has or "source_maps" in has else []
    rows = rows.withColumn("fold_page", fold(F.concat_ws("\n", "markup", *loaded))).withColumn("fold_copy", fold(F.col("low_copy")))
    rows = rows.withColumn("words_page", words_of(F.col("fold_page")))
    # only searched for colours
    rows = rows.withColumn("low_blob", F.when(reduce(lambda a, b: a | b, [F.contains("words_page", F.lit(h[1:])) for h in PALETTE]), F.lower("blob")).otherwise(""))
    return rows.withColumn("copy_language", declared_language(F.col("copy"))).withColumn("thin", F.col("readable") < THIN_BYTES).drop("assets")


def notes(p: DataFrame) -> DataFrame:
    """(page_id, notes): codes of what a reader should know of how a page was read."""
    said = {
        "little_markup": F.col("readable") < THIN_BYTES, "built_in_browser": (F.col("readable") >= THIN_BYTES) & (F.octet_length("html") < THIN_BYTES),
        "source_maps_read": F.exists("maps", lambda m: F.trim(m["content"]) != ""), "scripts_not_read": F.col("minified") & (F.size("maps") == 0), "scan_cut": F.col("scan_cut"), "one_direction": F.lit(True),
    }
    return p.select("page_id", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in said.items()]), lambda x: x.isNotNull()).alias("notes"))


def facts(p: DataFrame) -> DataFrame:
    """(page_id, framework, hosting, powered_by, security_headers, generator, title, lang, cms): recorded, but not scored."""
    header = lambda k: F.coalesce(F.col("headers")[k], F.lit(""))
    by_header = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [header(k) != "" for k in keys]), F.lit(name)) for name, keys in PLATFORM_HEADERS.items()])
    by_server = F.when(header("server").rlike("(?i)vercel|netlify|cloudflare|gse|awselb|nginx|apache|litespeed|caddy|openresty"), header("server"))
    text = lambda c, pattern: F.when(F.regexp_extract(c, pattern, 1) != "", F.trim(F.regexp_extract(c, pattern, 1)))
    return p.select(
        "page_id", first_of(F.col("blob"), FRAMEWORKS).alias("framework"), F.coalesce(by_header, by_server).alias("hosting"), F.when(header("x-powered-by") != "", header("x-powered-by")).alias("powered_by"),
        reduce(lambda a, b: a + b, [(header(k) != "").cast("int") for k in SECURITY_HEADERS]).alias("security_headers"), text("html", GENERATOR).alias("generator"),
        text("html", r"(?i)<title[^>]*>\s*([^<]{0,160})</title>").alias("title"), F.lower(text("html", r"(?i)<html[^>]+lang=[\"']([a-z]{2})")).alias("lang"), first_of(F.col("html"), CMS).alias("cms"),
    )


def _groups(as_of_year: int) -> list[dict[str, Column]]:
    """Rules in groups. A rule is a condition over the columns of prepare()."""
    html, hay, blob, copy, markup = "html", "hay", "blob", "copy", "markup"
    header = lambda k: F.coalesce(F.col("headers")[k], F.lit(""))
    comments = F.transform(all_of(html, r"(?s)<!--(.*?)-->"), F.trim)
    told = F.filter(comments, lambda c: (c != "") & ~c.rlike(SKIPPED_COMMENT))
    host = F.col("host")
    fingerprints = {s: any_of(hay, p) | (host.rlike(HOSTS[s]) if s in HOSTS else F.lit(False)) for s, p in FINGERPRINTS.items()}
    fingerprints |= {"fp.builder_other": any_of(hay, list(BUILDERS.values())), "fp.generator_meta": extract(html, GENERATOR, 1).rlike(GENERATOR_NAMES)}

    head = F.left(html, F.lit(65_536))
    scaffold = F.trim(F.regexp_extract(head, r"(?i)<title[^>]*>\s*([^<]{0,160})</title>", 1)).rlike(TITLE) | F.trim(F.regexp_extract(head, r"(?i)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"']([^\"']{0,200})[\"']", 1)).rlike(DESCRIPTION) | any_of(head, SCAFFOLD)
    images = all_of(html, r"(?i)<img\b[^>]*>", 0)
    supabase, firebase = like(blob, r"(?i)https?://[a-z0-9-]+\.supabase\.(?:co|in)"), like(blob, r"(?i)firebaseapp\.com|firebase(?:io|storage)") & like(blob, r"apiKey\s*[:=]\s*[\"']AIza")
    stored = (matches(blob, r"(?i)localStorage\s*(?:\.\s*setItem\s*\(|\[)") >= 3) & like(blob, r"(?i)localStorage[^;\n]{0,80}JSON\s*\.\s*stringify")
    structure = {
        "st.untouched_scaffold": scaffold,
        "st.generated_stack": how_many(F.concat_ws("\n", blob, "paths"), STACK, "fold_page") >= 4,
        "st.client_only_backend": supabase | firebase | stored,
        "se.exposed_client_key": (supabase & like(blob, r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}")) | firebase | like(blob, r"(?i)dangerouslyAllowBrowser\s*:\s*true") | like(blob, r"[\"'](?:sk-ant-[A-Za-z0-9_-]{10,}|sk-[A-Za-z0-9]{32,}|AKIA[0-9A-Z]{16})[\"']"),
        "se.client_side_auth": like(blob, r"(?i)(?:localStorage|sessionStorage)[^;\n]{0,60}[\"'](?:isLoggedIn|loggedIn|isAdmin|is_admin|isAuthenticated|auth(?:enticated)?|user_?role|isPremium|isPro)[\"']") | like(blob, r"(?i)[\"'](?:isLoggedIn|isAdmin|isAuthenticated)[\"']\s*,\s*[\"']true[\"']"),
        "st.spa_shell": extract(html, r"(?is)<body[^>]*>(.*)</body>", 1).rlike(r"(?i)<div[^>]+id=[\"'](?:root|app|__next)[\"'][^>]*>\s*</div>") & like(html, r"(?i)/assets/index-[A-Za-z0-9_-]{6,}\.js"),
        "st.full_scaffold": (how_many(html, HEAD_PARTS) >= 6) & (F.size(images) > 0) & F.forall(images, lambda i: i.rlike(r"(?i)\balt=")) & (matches(html, r"(?i)\baria-[a-z]+=") >= 4),
        "st.section_comments": F.size(F.filter(told, lambda c: c.rlike(SECTION_COMMENT))) >= 3,
        "cd.emoji_comments": F.exists(told, has_emoji),
    }

    names = reduce(lambda a, b: a + b, [F.contains("low_copy", F.lit(n.lower())).cast("int") for n in NAMES + TITLES])
    lists = {lang: how_many(copy, [f"(?iu){c}" for c in words]) for lang, words in CLICHES.items()}
    cliches = F.when(F.col("copy_language") == "fr", lists["fr"]).when(F.col("copy_language") == "es", lists["es"]).when(F.col("copy_language") == "de", lists["de"]).otherwise(lists["en"])
    hrefs = F.transform(all_of(html, r"(?i)<a\b[^>]*href=[\"']([^\"']*)[\"']"), F.trim)
    dead = F.size(F.filter(hrefs, lambda h: h.isin("#", "", "javascript:void(0)", "#!")))
    dashes, curly = matches(copy, r"\x{2014}"), matches(copy, r"[\x{2018}\x{2019}\x{201C}\x{201D}]")
    words = F.greatest(F.lit(1), word_count(F.col(copy)))
    content = {
        "ct.emoji_icons": F.size(F.array_distinct(all_of(html, r">\s*([\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}][\x{FE0F}]?)\s*<"))) >= 3,
        "ct.generic_names": names >= 2,
        "ct.marketing_cliche": cliches >= 3,
        "cd.typography": once(dashes, lambda n: ((n >= 3) & (n * 1000 >= 2.5 * words)) | ((n >= 2) & (curly >= 6))),
        "ct.placeholder_copy": any_of(copy, [f"(?iu){p}" for p in PLACEHOLDERS]),
        "ct.dead_links": (F.size(hrefs) >= 8) & (dead > 0.55 * F.size(hrefs)),
        "ct.stat_inflation": (reduce(lambda a, b: a + b, [matches(copy, p) for p in STATISTICS]) >= 2) & ~like(copy, SOURCED),
        "ct.pricing_three": like(copy, STARRED) & (matches(copy, PRICED) >= 3),
        "hu.long_tail_copy": how_many(copy, SPECIFICS) + (like(copy, r"\b(?:19|20)\d{2}\b") & like(copy, FOUNDED)).cast("int") >= 3,
    }

    own = F.lower(extract(html, r"(?i)<html[^>]+lang=[\"']([a-z]{2})", 1))
    lang = F.when((own.isin("", "en")) & (F.col("copy_language") != ""), F.col("copy_language")).otherwise(own)
    typos = {k: like(copy, r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(w) + r")(?![\p{L}\p{N}_])") for k, w in MISSPELLINGS.items()}
    years = F.transform(all_of(html, r"(?i)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"), lambda y: y.cast("int"))
    csp, hsts = header("content-security-policy"), header("strict-transport-security")
    age = F.regexp_extract(hsts, r"(?i)max-age=(\d{1,17})", 1)
    long_hsts = F.coalesce(F.when(age != "", age).cast("long") >= 15_768_000, F.lit(False))
    refs = F.concat(
        all_of(html, r"(?i)<img\b[^>]*\bsrc=[\"']([^\"']+)[\"']"), all_of(html, r"(?i)\b(?:data-src|data-lazy-src|data-original)=[\"']([^\"']+)[\"']"),
        F.transform(all_of(html, r"(?i)\bsrcset=[\"']([^\"']+)[\"']"), lambda s: F.regexp_extract(s, r"^[ ,]*([^ ,]+)", 1)), all_of(blob, r"(?i)background(?:-image)?:\s*(?:[^;}]*?)url\(\s*[\"']?([^\"')]+)"),
    )
    photos = F.filter(F.array_distinct(refs), lambda r: (r != "") & ~r.startswith("data:") & (r.rlike(PHOTO) | r.rlike(PIPELINE)))
    kinds = F.array_distinct(F.transform(photos, lambda r: F.when(r.rlike(PHOTO), F.lower(F.regexp_extract(r, r"(?i)\.(jpe?g|png|webp|avif|gif|heic)\b", 1))).otherwise("optimised")))
    gradients, vectors = matches(blob, r"(?i)bg-gradient-to-|linear-gradient\(|radial-gradient\("), matches(html, r"(?i)<svg\b")
    human = {
        "hu.typos": F.when(lang == "fr", typos["fr"]).when(lang == "es", typos["es"]).when(lang == "de", typos["de"]).otherwise(typos["en"]),
        "hu.operational_stack": how_many(html, OPERATIONS) >= 2,
        "hu.dated_copyright": F.coalesce(once(F.array_max(years), lambda y: (y > 1990) & (y < as_of_year)), F.lit(False)),
        "hu.cms": any_of(html, list(CMS.values())),
        "hu.hardened_headers": csp.rlike(r"(?i)(?:default|script|frame-ancestors|style)-src") & (long_hsts | (header("permissions-policy") != "")),
        "hu.legacy_stack": like(html, r"(?i)jquery(?:\.min)?\.js|jquery-\d") | like(html, r"(?i)<table[^>]*>\s*<tr") | like(blob, r"(?i)-webkit-border-radius|filter:\s*progid:") | header("set-cookie").rlike(SESSION_COOKIE),
        "hu.real_media": (F.size(photos) >= 5) & (F.size(kinds) >= 2),
        "ae.no_real_images": (F.size(photos) == 0) & ((gradients >= 3) | (vectors >= 5)) & (F.octet_length(html) > 4000),
        "hu.build_stripped": (F.size(comments) == 0) & like(html, HASHED_ASSET) & ~scaffold & (how_many(F.concat_ws("\n", blob, "paths"), STACK, "fold_page") < 4),
    }

    found = reduce(lambda a, b: a + b, [F.contains("low_blob", F.lit(h)).cast("int") for h in PALETTE])
    classes = F.size(F.slice(F.array_distinct(all_of(markup, PALETTE_CLASS, 0)), 1, 4))
    kinds_of_colour = (found > 0).cast("int") + (classes > 0).cast("int") + like(blob, GRADIENT).cast("int")
    families = "|".join(FONTS)
    fonts = like(blob, rf"(?i)font-family[^;}}\"']{{0,60}}(?:{families})|fonts\.googleapis\.com[^\"']*(?:{families.replace(' ', r'\+')})|[\"'](?:{families})[\"'][^;]{{0,40}};")
    # columns of hits(): a lambda must not capture an expression, which would be worked out again for every element
    steps, cards, lengths = F.col("_steps"), F.col("_cards"), F.col("_lengths")
    counted = F.transform(F.array_distinct(steps), lambda v: F.struct(F.size(F.filter(steps, lambda x: x == v)).alias("n"), v.cast("int").alias("v")))  # a hundred values at most
    top = F.array_max(counted)
    first_look = {
        "ae.indigo": (kinds_of_colour >= 2) | (found >= 3) | (classes >= 3),
        "ae.inter_font": fonts,
        "ae.lucide": like(blob, r"(?i)lucide|heroicons|@heroicons/") | like(markup, r"(?i)<svg[^>]+stroke-width=[\"']2[\"'][^>]*stroke-linecap=[\"']round"),
        "ae.shadcn_defaults": (matches(markup, r"(?i)class=[\"'][^\"']*\brounded-2xl\b[^\"']*\bshadow-(?:lg|xl|md)\b[^\"']*[\"']") >= 2) | (matches(markup, r"(?i)\brounded-(?:2xl|3xl|full)\b") >= 8) | like(markup, r"(?i)class=[\"'][^\"']*\brounded-2xl\b[^\"']*[\"'][^>]*>\s*<div[^>]+class=[\"'][^\"']*\brounded-(?:xl|2xl)\b"),
        "ae.uniform_whitespace": F.coalesce((F.size(steps) >= 3) & (top["v"] >= 16) & (top["n"] >= 3) & (top["n"] > 0.6 * F.size(steps)), F.lit(False)),
        "ae.gradient_text": like(markup, r"(?i)bg-clip-text[^\"']*text-transparent|text-transparent[^\"']*bg-clip-text") | like(blob, r"(?i)background-clip:\s*text"),
        "ae.glassmorphism": matches(markup, r"(?i)backdrop-blur(?:-\w+)?\b") + matches(blob, r"(?i)backdrop-filter:\s*blur") >= 3,
        "ae.hero_pill": extract(markup, PILL, 0).rlike(ANNOUNCE),
        "ae.scroll_indicator": like(markup, r"(?i)class=[\"'][^\"']*\b(?:scroll-(?:indicator|down|hint|cue)|mouse-scroll|animate-bounce)\b") | like(copy, r"(?i)(?:scroll (?:down|to explore)|explore more)\s*(?:<|$)"),
    }
    bars = F.array_join(all_of(markup, r"(?i)<(?:header|nav)[^>]*class=[\"']([^\"']+)[\"']"), " ")
    card = lambda i: F.get(cards, i)
    # a run of three or four equal ones in the sorted array
    same = F.exists(F.sequence(F.lit(0), F.size(cards)), lambda i: (card(i) == card(i + 2)) & ((i == 0) | (card(F.greatest(i - 1, F.lit(0))) != card(i))) & (card(i + 4).isNull() | (card(i + 4) != card(i))))
    n, total, squares = F.size(lengths), F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x), F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x * x)
    # mean > 8 and deviation < 0.18 of the mean, over whole numbers
    even = (n >= 3) & (total > 8 * n) & (F.sqrt((n * squares - total * total).cast("double")) < 0.18 * total)
    second_look = {
        "ae.glow_orbs": matches(markup, r"(?i)class=[\"'][^\"']*\b(?:blur-(?:2xl|3xl)|rounded-full)\b[^\"']*\b(?:absolute|fixed)\b[^\"']*[\"']") + matches(markup, r"(?i)class=[\"'][^\"']*\b(?:absolute|fixed)\b[^\"']*\bblur-(?:2xl|3xl)\b[^\"']*[\"']") + matches(blob, r"(?i)filter:\s*blur\((?:6[0-9]|[7-9][0-9]|\d{3,})px\)") >= 2,
        "ae.bento_grid": (matches(markup, r"(?i)\b(?:col|row)-span-[2-6]\b") >= 4) & like(markup, r"(?i)\bgrid-cols-(?:3|4|6|12)\b"),
        "ae.logo_marquee": like(markup, r"(?i)class=[\"'][^\"']*\b(?:marquee|animate-marquee|logo-?(?:scroll|ticker|cloud|strip)|infinite-scroll)\b") | (like(blob, r"(?i)@keyframes\s+(?:marquee|scroll|ticker)") & like(copy, r"(?i)trusted by|as seen (?:in|on)|used by|powering")),
        "ae.floating_nav": (bars.rlike(r"(?i)\b(?:fixed|sticky)\b") & bars.rlike(r"(?i)\bbackdrop-blur") & bars.rlike(r"(?i)\b(?:rounded-full|rounded-2xl|mx-auto|inset-x-|top-[2-9])")) | like(markup, r"(?i)class=[\"'][^\"']*\b(?:fixed|sticky)\b[^\"']*\bbackdrop-blur[^\"']*\b(?:rounded-full|rounded-2xl|inset-x-|mx-auto)"),
        "ae.left_border_card": (like(markup, r"(?i)border-l-(?:2|4|\[\d)") & like(markup, r"(?i)\bborder-l-\d?\s*[^\"']*\bborder-(?:indigo|violet|purple|blue|emerald|amber)-\d{3}")) | like(blob, r"(?i)border-left:\s*(?:3|4|5)px\s+solid"),
        "ae.three_cards": (F.size(F.array_distinct(all_of(markup, r">\s*0([123])\s*<"))) >= 3).cast("int") + same.cast("int") + even.cast("int") >= 2,
    }
    return [fingerprints, structure, content, human, first_look, second_look]


def _evidence() -> dict[str, Column]:
    """What is shown for a signal that fires: the first text that each of its patterns matches, or the values it counted."""
    html, hay, blob, copy, markup = "html", "hay", "blob", "copy", "markup"
    first = lambda s, patterns: F.filter(F.array(*[F.regexp_extract(s, f"({p})" if not p.startswith("(?i") else p.replace(")", ")(", 1) + ")", 1) for p in patterns]), lambda x: x != "")
    held = lambda s, words: F.filter(F.array(*[F.when(F.contains(s, F.lit(w.lower())), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    named = lambda s, patterns: F.filter(F.array(*[F.when(like(s, p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    found = {s: first(hay, p) for s, p in FINGERPRINTS.items()}
    found |= {
        "fp.builder_other": named(hay, BUILDERS), "fp.generator_meta": F.array(extract(html, GENERATOR, 1)), "st.untouched_scaffold": first(F.left(html, F.lit(65_536)), SCAFFOLD), "st.generated_stack": first(F.concat_ws("\n", blob, "paths"), STACK),
        "st.section_comments": F.filter(F.transform(all_of(html, r"(?s)<!--(.*?)-->"), F.trim), lambda c: (c != "") & c.rlike(SECTION_COMMENT)), "cd.emoji_comments": F.filter(F.transform(all_of(html, r"(?s)<!--(.*?)-->"), F.trim), has_emoji),
        "ct.generic_names": held(F.col("low_copy"), NAMES + TITLES), "ct.placeholder_copy": first(copy, [f"(?iu){p}" for p in PLACEHOLDERS]), "ct.stat_inflation": F.flatten(F.array(*[all_of(copy, p, 0) for p in STATISTICS])), "ct.pricing_three": all_of(copy, PRICED, 0),
        "ct.marketing_cliche": first(copy, [f"(?iu){c}" for words in CLICHES.values() for c in words]), "hu.cms": named(html, CMS), "hu.operational_stack": first(html, OPERATIONS), "hu.long_tail_copy": first(copy, SPECIFICS), "hu.dated_copyright": all_of(html, r"(?i)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})", 0),
        "hu.typos": first(copy, [r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(w) + r")(?![\p{L}\p{N}_])" for w in MISSPELLINGS.values()]), "ae.indigo": F.concat(held(F.col("low_blob"), PALETTE), F.array_distinct(all_of(markup, PALETTE_CLASS, 0))), "ae.hero_pill": F.array(F.regexp_replace(extract(markup, PILL, 0), "<[^>]*>", " ")),
    }
    return found


def hits(prepared: DataFrame, as_of_year: int, evidence: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(page_id, signal_id, fire_seq), with the columns to keep, of the signals that fire; as_of_year is the year that copyright notes are compared with.

    With evidence, an array of excerpts is added, empty where a signal counts nothing that could be shown. A page with a fingerprint doesn't show hu.build_stripped.
    """
    markup = "markup"
    found = prepared.withColumn("_steps", F.filter(F.array_sort(all_of(markup, r"\bpy-(\d{2})\b")), lambda x: x.isNotNull()))
    found = found.withColumn("_cards", F.array_sort(F.filter(all_of(markup, r"(?i)<(?:div|article|li)\s+class=[\"']([^\"']{25,})[\"']"), lambda c: c.rlike(r"(?i)\b(?:card|feature|benefit|rounded|shadow|p-6|p-8)\b"))))
    found = found.withColumn("_lengths", F.transform(all_of(markup, r"(?i)<p[^>]*>([^<]{40,240})</p>"), word_count))
    seq, arrays = 0, []
    shown, none = _evidence() if evidence else {}, F.array().cast("array<string>")
    for k, group in enumerate(_groups(as_of_year)):
        names = F.array(*[F.when(rule, F.struct(F.lit(s).alias("signal_id"), F.lit(seq + i).alias("fire_seq"))) for i, (s, rule) in enumerate(group.items())])
        found = found.withColumn(f"_g{k}", F.filter(names, lambda x: x.isNotNull()))
        arrays.append(f"_g{k}")
        seq += len(group)
    rows = found.withColumn("_fp", F.size("_g0") > 0).withColumn("h", F.explode(F.concat(*arrays)))
    rows = rows.filter(~(F.col("_fp") & (F.col("h.signal_id") == "hu.build_stripped")))
    if not evidence:
        return rows.select("page_id", *keep, "h.*")
    lines = F.when(F.lit(False), none)
    for s, e in shown.items():
        lines = lines.when(F.col("h.signal_id") == s, e)
    return rows.select("page_id", *keep, "h.*", F.coalesce(lines, none).alias("evidence"))
