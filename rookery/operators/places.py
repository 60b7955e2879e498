"""Places: locations cut into segments, each read as city, state, country, and the workplace that follows from an allow-list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery.functions.urls import bound

# States by code, countries and regions elsewhere, cities that stand for a state, one city's other names.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia", "fl": "florida", "ga": "georgia", "hi": "hawaii",
    "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi",
    "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
HOME = ["united states", "united states of america", "usa", "us", "u s", "u s a", "america"]
PROVINCES = ["alberta", "british columbia", "manitoba", "new brunswick", "newfoundland", "newfoundland and labrador", "northwest territories", "nova scotia", "nunavut", "ontario", "prince edward island", "quebec", "saskatchewan", "yukon"]
PROVINCE_CODES = ["ab", "bc", "mb", "nb", "nl", "ns", "nt", "nu", "on", "pe", "qc", "sk", "yt"]
CANADIAN_CITIES = ["calgary", "edmonton", "halifax", "hamilton", "kitchener", "mississauga", "montreal", "ottawa", "quebec city", "saskatoon", "toronto", "vancouver", "victoria", "waterloo", "winnipeg"]
COUNTRIES = [
    "afghanistan", "albania", "algeria", "andorra", "angola", "argentina", "armenia", "australia", "austria", "azerbaijan", "bahamas", "bahrain", "bangladesh", "barbados", "belarus", "belgium", "belize", "benin", "bermuda", "bhutan", "bolivia",
    "bosnia", "bosnia and herzegovina", "botswana", "brazil", "brunei", "bulgaria", "burkina faso", "cambodia", "cameroon", "canada", "cayman islands", "chad", "chile", "china", "colombia", "costa rica", "croatia", "cuba", "cyprus", "czech republic",
    "czechia", "denmark", "dominican republic", "ecuador", "egypt", "el salvador", "england", "estonia", "ethiopia", "fiji", "finland", "france", "gabon", "gambia", "germany", "ghana", "gibraltar", "great britain", "greece", "guatemala", "guernsey",
    "guyana", "haiti", "honduras", "hong kong", "hungary", "iceland", "india", "indonesia", "iran", "iraq", "ireland", "isle of man", "israel", "italy", "ivory coast", "jamaica", "japan", "jersey", "kazakhstan", "kenya", "korea", "kosovo", "kuwait",
    "kyrgyzstan", "laos", "latvia", "lebanon", "liberia", "libya", "liechtenstein", "lithuania", "luxembourg", "macau", "macedonia", "madagascar", "malawi", "malaysia", "maldives", "mali", "malta", "mauritius", "mexico", "moldova", "monaco",
    "mongolia", "montenegro", "morocco", "mozambique", "myanmar", "namibia", "nepal", "netherlands", "the netherlands", "new zealand", "nicaragua", "niger", "nigeria", "north macedonia", "northern ireland", "norway", "oman", "pakistan", "panama",
    "papua new guinea", "paraguay", "peru", "philippines", "poland", "portugal", "qatar", "romania", "russia", "rwanda", "saudi arabia", "scotland", "senegal", "serbia", "sierra leone", "singapore", "slovakia", "slovenia", "somalia", "south africa",
    "south korea", "spain", "sri lanka", "sudan", "suriname", "sweden", "switzerland", "syria", "taiwan", "tajikistan", "tanzania", "thailand", "togo", "trinidad and tobago", "tunisia", "turkey", "turkmenistan", "uae", "uganda", "uk", "ukraine",
    "united arab emirates", "united kingdom", "uruguay", "uzbekistan", "venezuela", "vietnam", "wales", "yemen", "zambia", "zimbabwe",
]
REGIONS = ["africa", "apac", "asia", "asia pacific", "caribbean", "central america", "eastern europe", "emea", "eu", "europe", "european union", "latam", "latin america", "mena", "middle east", "nordics", "oceania", "south america", "southeast asia", "western europe"]
FOREIGN_CITIES = [
    "amsterdam", "athens", "auckland", "bangalore", "bangkok", "barcelona", "beijing", "belgrade", "bengaluru", "berlin", "bogota", "brussels", "bucharest", "budapest", "buenos aires", "cairo", "calgary", "cape town", "chennai", "cologne",
    "copenhagen", "delhi", "dubai", "dublin", "edinburgh", "edmonton", "frankfurt", "geneva", "guadalajara", "gurgaon", "gurugram", "hamburg", "helsinki", "ho chi minh city", "hyderabad", "istanbul", "jakarta", "johannesburg", "karachi", "kolkata",
    "krakow", "kuala lumpur", "kyiv", "lagos", "lahore", "lima", "lisbon", "london", "madrid", "manila", "medellin", "melbourne", "mexico city", "milan", "montreal", "moscow", "mumbai", "munich", "nairobi", "new delhi", "noida", "osaka", "oslo",
    "ottawa", "oxford", "paris", "porto", "prague", "pune", "quebec city", "rio de janeiro", "riyadh", "rome", "santiago", "sao paulo", "seoul", "shanghai", "shenzhen", "sofia", "stockholm", "sydney", "taipei", "tallinn", "tel aviv", "tokyo",
    "toronto", "vancouver", "vienna", "vilnius", "warsaw", "waterloo", "winnipeg", "wroclaw", "zagreb", "zurich",
]
ELSEWHERE = [*COUNTRIES, *REGIONS, *PROVINCES, *FOREIGN_CITIES]
CITIES = {
    "anaheim": "ca", "austin": "tx", "bay area": "ca", "bellevue": "wa", "berkeley": "ca", "beverly hills": "ca", "boston": "ma", "boulder": "co", "bronx": "ny", "brooklyn": "ny", "burbank": "ca", "carlsbad": "ca", "chicago": "il", "culver city": "ca",
    "cupertino": "ca", "dallas": "tx", "denver": "co", "detroit": "mi", "emeryville": "ca", "foster city": "ca", "fremont": "ca", "fresno": "ca", "houston": "tx", "irvine": "ca", "kirkland": "wa", "las vegas": "nv", "long beach": "ca", "los angeles": "ca",
    "los gatos": "ca", "manhattan": "ny", "menlo park": "ca", "miami": "fl", "milwaukee": "wi", "minneapolis": "mn", "mountain view": "ca", "nashville": "tn", "new orleans": "la", "new york": "ny", "new york city": "ny", "nyc": "ny", "oakland": "ca",
    "palo alto": "ca", "pasadena": "ca", "philadelphia": "pa", "phoenix": "az", "pittsburgh": "pa", "pleasanton": "ca", "portland": "or", "queens": "ny", "raleigh": "nc", "redmond": "wa", "redwood city": "ca", "sacramento": "ca", "salt lake city": "ut",
    "san antonio": "tx", "san diego": "ca", "san francisco": "ca", "san francisco bay area": "ca", "san jose": "ca", "san mateo": "ca", "santa clara": "ca", "santa monica": "ca", "seattle": "wa", "sf": "ca", "staten island": "ny", "sunnyvale": "ca", "tampa": "fl",
    "walnut creek": "ca",
}
GROUP = ["new york", "new york city", "nyc", "manhattan", "brooklyn", "queens", "bronx", "staten island"]
REMOTE = r"\b(remote\w*|anywhere|work from home|wfh|distributed|fully distributed)\b"
MODES = r"\b(hybrid|onsite|on site|in person|in office|any office|office|headquarters|hq)\b"
PLACEHOLDER = r"(?i)^\s*(?:n/?a|tbd|tba|none|unknown|various|-+|\.+)?\s*$"


def _literals(values) -> Column:
    """The values as one constant that the optimizer folds, and not as an expression for each."""
    return F.split(F.lit("|".join(values)), "[|]")


def _map(values: dict) -> Column:
    return F.str_to_map(F.lit("|".join(f"{k}:{v}" for k, v in values.items())), F.lit("[|]"), F.lit(":"))


def segments(location: Column) -> Column:
    """The parts of a location that stand apart, lower-cased; a bracketed "remote" belongs to what is before it, other brackets stand apart."""
    lower = F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), r"\(\s*remote\s*\)", " remote ")
    cut = F.split(lower, r"[·•|;/\n()\[\]]|\s&\s|\s(?:and|or)\s")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def _holds(text: Column, words: Column) -> Column:
    """Whether the words stand in the text as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


PLACE = "struct<city:string,state:string,home:boolean,abroad:boolean,foreign_city:boolean,inferred:string,last:string,n:int>"


def read_segment(segment: Column) -> Column:
    """(remote, places) of one segment: its parts between commas are put together to places, each (city, state, home, abroad, country_only).

    A state or a country ends a city's place, so that a city after it begins the next: "San Francisco, CA, USA, New York, NY" is two. A foreign city is abroad unless a state follows ("Paris, TX"), and "CA" behind a city or province of
    Canada is the country. A city that isn't known by itself may hold a known one ("Los Angeles Metropolitan Area"), or a state's name.
    """
    codes, names, cities = _literals(STATES), _map({name: code for code, name in STATES.items()}), _map(CITIES)
    in_ = lambda values, w: F.array_contains(_literals(values), w)
    cleaned = F.transform(F.split(segment, r",|\s[-–—]+\s"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[^a-z0-9 ]+", " "), r"\b[0-9]{5}( [0-9]{4})?\b", " "), f"{REMOTE}|{MODES}", " "), " +", " ")))
    parts = F.filter(cleaned, lambda p: (p != "") & ~p.rlike("^[0-9]"))
    none = F.from_json(F.lit('{"home":false,"abroad":false,"foreign_city":false,"n":0}'), PLACE)
    longest = lambda p: F.try_element_at(F.array_sort(F.transform(F.filter(_literals(c for c in CITIES if len(c) > 2), lambda c: _holds(p, c)), lambda c: F.struct(F.length(c).alias("l"), c.alias("c")))), F.lit(-1))["c"]
    state_in = lambda p: F.element_at(names, F.get(F.filter(_literals(STATES.values()), lambda n: _holds(p, n)), 0))

    def with_(c: Column, p: Column, **changed: Column) -> Column:
        kept = {k: c[k] for k in ("city", "state", "home", "abroad", "foreign_city", "inferred")} | changed
        return F.struct(*(kept[k].cast("boolean" if k in ("home", "abroad", "foreign_city") else "string").alias(k) for k in ("city", "state", "home", "abroad", "foreign_city", "inferred")), p.alias("last"), (c["n"] + 1).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        cur, done = acc["cur"], acc["done"]
        state_name = F.element_at(names, p).isNotNull() & ~((cur["n"] == 0) & F.element_at(cities, p).isNotNull())
        state = state_name | ((cur["n"] > 0) & F.array_contains(codes, p))
        canada = (p == "ca") & (in_(CANADIAN_CITIES, cur["last"]) | in_(PROVINCES, cur["last"]) | in_(PROVINCE_CODES, cur["last"]))
        province = (cur["n"] > 0) & (in_(PROVINCES, p) | in_(PROVINCE_CODES, p))
        abroad = in_([*COUNTRIES, *REGIONS, *PROVINCES], p) | F.exists(_literals(c for c in COUNTRIES if " " in c), lambda c: _holds(p, c))
        yes = F.lit(True)
        # what closes the place before this part, what this part makes of the place it belongs to, and whether it closes that
        closes = F.when(state & ~canada, cur["state"].isNotNull()).when(canada | in_(HOME, p) | province | abroad, F.lit(False)).otherwise(cur["city"].isNotNull() | cur["state"].isNotNull())
        base = F.when(closes, none).otherwise(cur)
        before = F.when(closes & (cur["n"] > 0), F.concat(done, F.array(cur))).otherwise(done)
        known = F.coalesce(F.element_at(cities, p), F.when(~in_(FOREIGN_CITIES, p) & ~in_(CANADIAN_CITIES, p), F.element_at(cities, longest(p))))
        foreign = F.element_at(cities, p).isNull() & (in_(FOREIGN_CITIES, p) | in_(CANADIAN_CITIES, p))
        told = F.when(known.isNull() & ~foreign, state_in(p))
        made = (
            F.when(state & canada, with_(base, p, abroad=yes)).when(state, with_(base, p, state=F.when(state_name, F.element_at(names, p)).otherwise(p), home=yes)).when(in_(HOME, p), with_(base, p, home=yes))
            .when(province | abroad, with_(base, p, abroad=yes)).otherwise(with_(base, p, city=p, inferred=known, foreign_city=foreign, state=F.coalesce(base["state"], told), home=base["home"] | told.isNotNull()))
        )
        ends = ~state & (in_(HOME, p) | (abroad & ~province))
        return F.struct(F.when(ends, F.concat(before, F.array(made))).otherwise(before).alias("done"), F.when(ends, none).otherwise(made).alias("cur"))

    start = F.struct(F.array().cast(f"array<{PLACE}>").alias("done"), none.alias("cur"))
    read = F.aggregate(parts, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["cur"])), lambda c: c["n"] > 0))

    def settled(c: Column) -> Column:
        abroad = c["abroad"] | (c["foreign_city"] & c["state"].isNull())
        state = F.coalesce(c["state"], F.when(~abroad, c["inferred"]))
        only = c["city"].isNull() & state.isNull() & ~abroad & c["home"]
        return F.struct(c["city"].alias("city"), state.alias("state"), (c["home"] | state.isNotNull()).alias("home"), abroad.alias("abroad"), only.alias("country_only"))

    return F.struct(F.regexp_replace(segment, "[^a-z0-9]+", " ").rlike(REMOTE).alias("remote"), F.transform(read, settled).alias("places"))


def allowed(entry: str) -> tuple[str | None, str | None]:
    """(city, state) of an entry of an allow-list: a state by name or code, a city in a state, or a city with the state it is known for."""
    parts = [" ".join("".join(c if c.isalnum() else " " for c in p.lower()).split()) for p in entry.split(",")]
    parts = [p for p in parts if p]
    by_name = {name: code for code, name in STATES.items()}
    if len(parts) == 1:
        p = parts[0]
        return (None, by_name.get(p, p)) if p in {*by_name, *STATES} and p not in CITIES else (p, CITIES.get(p))
    return (parts[0], by_name.get(parts[1], parts[1] if parts[1] in STATES else None)) if parts else (None, None)


def workplace(location: Column, allow: list[str]) -> Column:
    """office, remote, unknown or other: an accepted place first, then remote at home, then nothing said at all.

    Remote counts if its segment names nothing abroad, and names home or nothing else in the location is abroad; so does the country alone if no place in it is named. Without an allow-list every place at home is accepted.
    Location strings repeat massively: classify distinct ones and join them back, as prefilter.classify does.
    """
    entries = [e for e in map(allowed, allow) if any(e)]

    def accepted(p: Column) -> Column:
        if not allow:
            return p["home"] & ~p["abroad"] & (p["city"].isNotNull() | p["state"].isNotNull())
        found = F.lit(False)
        for city, state in entries:
            if city is None:
                one = p["state"] == state
            else:
                named = F.lit(False)
                for n in GROUP if city in GROUP else [city]:
                    named = named | _holds(p["city"], F.lit(n))
                one = named & (F.coalesce(p["state"] == state, F.lit(True)) if state else F.lit(True))
            found = found | F.coalesce(one, F.lit(False))
        return found & ~p["abroad"]

    def told(read: Column) -> Column:
        every = F.flatten(F.transform(read, lambda s: s["places"]))

        def judged(places: Column) -> Column:
            abroad = F.exists(places, lambda p: p["abroad"])
            remote = F.exists(read, lambda s: s["remote"] & ~F.exists(s["places"], lambda p: p["abroad"]) & (F.exists(s["places"], lambda p: p["home"]) | ~abroad))
            country = F.exists(places, lambda p: p["country_only"]) & ~F.exists(places, lambda p: p["home"] & (p["city"].isNotNull() | p["state"].isNotNull()))
            return F.when(F.exists(places, accepted), "office").when(remote | country, "remote").otherwise("other")

        return bound(every, judged)

    return F.when(F.coalesce(location, F.lit("")).rlike(PLACEHOLDER), "unknown").otherwise(bound(F.transform(segments(location), read_segment), told))
