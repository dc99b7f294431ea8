"""Column functions on URLs, file names and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wiki namespaces whose pages are no articles (fixed values).
NAMESPACES = ("Special", "File", "Category", "Template", "Help", "Talk", "User", "Wikipedia", "Portal")
#: Endings of media and archives (fixed values).
BINARY_EXTENSIONS = ("avi", "mp4", "mov", "wmv", "webm", "mp3", "ppt", "pptx", "xls", "xlsx", "zip", "exe")
#: Folders of assets, not pages (fixed values).
ASSET_FOLDERS = ("assets", "css", "js", "images", "img", "fonts", "media", "static", "scripts", "styles", "_assets", "icons", "thumbs", "data", "lib")
#: Folders that hold no source (fixed values).
SYSTEM_FOLDERS = ("chroma_db_1536", "chroma_db_768", "models", "translations", "visualisation", "visualisations", "cache", "temp", "tmp")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def second_level_domain(url: Column) -> Column:
    """``example`` of ``www.example.org``; the host itself if it has no dot."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def display_url(url: Column, local_url: Column, hosted: bool) -> Column:
    return url if hosted else F.coalesce(F.nullif(local_url, F.lit("")), url)


def filename_to_title(filename: Column) -> Column:
    for end in (".htm.html", ".html", ".htm"):
        filename = F.replace(filename, F.lit(end), F.lit(""))
    return F.translate(filename, "_", " ")


def filename_to_url(filename: Column) -> Column:
    """A path, or the full URL where the name starts with a domain."""
    path = F.replace(F.replace(filename, F.lit(".htm.html"), F.lit(".htm")), F.lit(".html"), F.lit(""))
    first = F.split_part(path, F.lit("_"), F.lit(1))
    archived = F.contains(path, F.lit("_")) & F.contains(first, F.lit(".")) & ~F.startswith(first, F.lit("."))
    rest = F.translate(F.substr(path, F.length(first) + 2), "_", "/")
    return F.when(archived, F.concat(F.lit("https://"), first, F.lit("/"), rest)).otherwise(F.concat(F.lit("/"), path))


def is_system_folder(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*SYSTEM_FOLDERS) | F.startswith(low, F.lit("chroma_db_"))


def in_asset_folder(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, ASSET_FOLDERS)))


def is_binaryish(title: Column, url: Column, content: Column) -> Column:
    """Media and archives by name, or content that isn't text in its first 400 characters."""
    ending = r"(?s).*\.(" + "|".join(BINARY_EXTENSIONS) + ")$"
    head = F.left(F.coalesce(content, F.lit("")), F.lit(400))
    broken = F.regexp_count(head, F.lit("�")) >= 3
    control = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) >= 8
    named = F.lower(F.coalesce(title, F.lit(""))).rlike(ending) | F.lower(F.coalesce(url, F.lit(""))).rlike(ending)
    return named | broken | control


def html_title(html: Column, url: Column) -> Column:
    """The title element, else the first h1, else the URL's tail, else Untitled."""

    def inner(tag: str) -> Column:
        found = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.nullif(F.trim(F.regexp_replace(found, r"<[^>]*>", "")), F.lit(""))

    tail = F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]*)$", 1), F.lit(""))
    return F.coalesce(inner("title"), inner("h1"), tail, F.lit("Untitled"))


def internal_links(html: Column) -> Column:
    """Distinct paths of links within the site, in order, without fragment and query."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    outward = r"^(#|https?://|javascript:|mailto:|tel:)"
    special = "/(" + "|".join(NAMESPACES) + "):"
    own = F.filter(found, lambda h: (h != "") & ~h.rlike(outward) & ~h.rlike(special))
    paths = F.transform(own, lambda h: F.regexp_extract(h, r"^([^#?]*)", 1))
    paths = F.filter(paths, lambda p: p != "")
    return F.array_distinct(F.transform(paths, lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))))


def youtube_id(url: Column) -> Column:
    """The 11 characters of a video id, from watch, embed, shorts, live and short links; null elsewhere."""
    on_host = url.rlike(r"(?i)^https?://(www\.|m\.|music\.)?(youtube\.com|youtu\.be)/")
    short = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?youtu\.be/([\w-]{11})(?:[/?&#]|$)", 1)
    query = F.regexp_extract(url, r"[?&]v=([\w-]{11})(?:[&#]|$)", 1)
    path = F.regexp_extract(url, r"/(?:embed|shorts|live|v)/([\w-]{11})(?:[/?&#]|$)", 1)
    return F.when(on_host, F.coalesce(*[F.nullif(c, F.lit("")) for c in (short, query, path)]))


def doi(text: Column) -> Column:
    """The first DOI, without the marks that end a sentence; null if there is none."""
    found = F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;:)]+$", ""), F.lit(""))


#: Endings of hosts that name themselves without a slash before (fixed values).
KNOWN_ENDS = (".gov", ".org", ".com", ".edu", ".net", ".io")


def online_url(url: Column, base: Column) -> Column:
    """A full URL: as it is, by the domain in its first segment, or below ``base`` with one slash between."""
    rooted = F.startswith(url, F.lit("/"))
    bare = F.when(rooted, F.substr(url, F.lit(2))).otherwise(url)
    first = F.split_part(bare, F.lit("/"), F.lit(1))
    dotted = F.contains(first, F.lit(".")) & ~F.startswith(first, F.lit("."))
    known = F.startswith(first, F.lit("www."))
    for end in KNOWN_ENDS:
        known = known | F.endswith(first, F.lit(end))
    below = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), bare)
    return (
        F.when((url == "") | url.rlike("^https?://"), url)
        .when(dotted & (rooted | known), F.concat(F.lit("https://"), bare))
        .when(F.coalesce(base, F.lit("")) == "", url)
        .otherwise(below)
    )


def browsable_url(url: Column, base: Column | None = None) -> Column:
    """An archive's URL as a local path, or below the base URL of its site; null if it names no article."""
    source, path = F.regexp_extract(url, r"^zim://([^/]*)/(.*)$", 1), F.regexp_extract(url, r"^zim://([^/]*)/(.*)$", 2)
    local = F.concat(F.lit("/zim/"), source, F.lit("/"), path)
    if base is not None:
        web = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))
        local = F.when(F.coalesce(base, F.lit("")) != "", web).otherwise(local)
    return F.when(~F.startswith(url, F.lit("zim://")), url).when(url.rlike("^zim://[^/]*/"), local)


def is_archived_web(paths: Column) -> Column:
    """Whether one of an archive's paths starts with a domain."""
    return F.exists(paths, lambda p: p.rlike(r"^(A/)?(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)*\.(gov|org|com|edu|net|io)/"))


def web_asset_candidates(url: Column, domains: Column) -> Column:
    """Where an asset may be in an archive of web sites, in order: as asked, without slash, below each domain with and without www."""
    clean = F.regexp_replace(url, "^/+", "")
    twin = lambda d: F.when(F.startswith(d, F.lit("www.")), F.substr(d, F.lit(5))).otherwise(F.concat(F.lit("www."), d))
    below = F.flatten(F.transform(domains, lambda d: F.array(F.concat(d, F.lit("/"), clean), F.concat(twin(d), F.lit("/"), clean))))
    return F.array_distinct(F.concat(F.array(url, clean), below))


def wiki_asset_candidates(url: Column) -> Column:
    """Where an asset may be in an archive of a wiki: prefixes with underscores stand for namespaces."""
    kind, rest = F.regexp_extract(url, r"^_(\w+?)_/(.*)$", 1), F.regexp_extract(url, r"^_(\w+?)_/(.*)$", 2)
    name = F.regexp_extract(rest, r"([^/]*)$", 1)
    common = F.array(url, F.concat(F.lit("-/"), kind, F.lit("/"), rest), F.concat(F.lit("-/"), rest), rest, F.concat(F.lit("A/"), kind, F.lit("/"), rest), F.concat(F.lit("M/"), rest))
    images = F.array(*[F.concat(F.lit(p), x) for x in (rest, name) for p in ("I/", "I/m/", "A/")], name)
    styles = F.array(*[F.concat(F.lit(p), rest) for p in ("-/style/", "-/js/", "-/s/", "-/skin/", "-/skins/")])
    return F.array_distinct(F.when(kind == "", F.array(url)).when(kind == "assets", F.concat(common, images)).otherwise(F.concat(common, styles)))


def url_categories(url: Column, html: Column) -> Column:
    """Segments of the path that are no pages, and what the page's meta elements list, in one form."""
    from .tags import normalise_all

    parts = F.filter(path_segments(url), lambda p: ~p.rlike(r"\.html?$"))
    listed = F.regexp_extract(html, r"(?is)<meta[^>]*name=\"(?:keywords|category|categories)\"[^>]*content=\"([^\"]*)\"", 1)
    return normalise_all(F.concat(parts, F.transform(F.split(listed, ","), lambda c: F.trim(c))))


def localise_links(html: Column, source: Column) -> Column:
    """Links from the site's root lead to the source's place on a local server."""
    return F.regexp_replace(html, r"(?i)((?:href|src)=\")/(?!/)", F.concat(F.lit("$1/local/"), source, F.lit("/")))


def without_trackers(html: Column) -> Column:
    """Scripts and frames of advertisers and trackers are cut out."""
    hosts = r"(?:google-analytics|googletagmanager|doubleclick|googlesyndication|facebook\.net|hotjar|scorecardresearch)"
    html = F.regexp_replace(html, rf"(?is)<script[^>]*src=\"[^\"]*{hosts}[^\"]*\"[^>]*>.*?</script>", "")
    html = F.regexp_replace(html, rf"(?is)<iframe[^>]*{hosts}[^>]*>.*?</iframe>", "")
    return F.regexp_replace(html, rf"(?is)<script(?![^>]*src=)[^>]*>(?:(?!</script>).)*(?:gtag\(|{hosts})(?:(?!</script>).)*</script>", "")
