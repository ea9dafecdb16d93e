"""Curated domains, query patterns, ports. They must equal what the metrics are defined with."""

from __future__ import annotations

#: Ports of messengers.
CHAT_PORTS = (5222, 5223, 443)
DHCP_PORTS = (67, 68, 546, 547)

#: Curated second-level domains by category. Entries of three labels match nothing, as two labels are compared.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "social": (
        "facebook.com", "fbcdn.net", "instagram.com", "whatsapp.com", "snapchat.com", "tiktok.com", "tiktokcdn.com", "twitter.com", "x.com", "reddit.com", "discord.com", "discord.gg",
        "telegram.org", "signal.org", "wechat.com", "line.me", "vk.com", "gmx.com", "slack.com", "xing.com", "skype.com", "teams.microsoft.com", "yammer.com",
    ),
    "streaming": (
        "googlevideo.com", "youtube.com", "ytimg.com", "netflix.com", "nflxvideo.net", "primevideo.com", "amazonvideo.com", "cloudfront.net", "disneyplus.com", "spotify.com", "soundcloud.com",
        "deezer.com", "hulu.com", "srf.ch", "play.srf.ch", "zdf.de", "ard.de", "ardmediathek.de", "orf.at", "tvthek.orf.at", "rtlplus.com",
    ),
    "productivity": (
        "notion.so", "todoist.com", "trello.com", "asana.com", "microsoft.com", "office.com", "outlook.com", "live.com", "google.com", "calendar.google.com", "docs.google.com", "github.com",
        "gitlab.com", "bitbucket.org", "evernote.com", "gmx.net", "web.de", "posteo.de", "proton.me", "tutanota.com",
    ),
    "food": (
        "ubereats.com", "deliveroo.com", "just-eat.co.uk", "justeat.com", "doordash.com", "grubhub.com", "lieferando.de", "takeaway.com", "dominos.com", "pizza.de", "foodpanda.com", "wolt.com",
        "justeat.ch", "just-eat.ch", "lieferando.at", "lieferando.ch", "mjam.at", "pizza.ch", "pizza.at",
    ),
    "diet": ("myfitnesspal.com", "fitbit.com", "loseit.com", "yazio.com", "cronometer.com", "noom.com", "lifesum.com", "weightwatchers.com", "fatsecret.com", "fddb.info", "fatsecret.de"),
    "scale": ("withings.com", "garmin.com", "renpho.com", "tanita.com", "xiaomi.com", "fitbit.com", "beurer.com", "omronconnect.com"),
    "mental_health": (
        "psychologytoday.com", "mind.org.uk", "mentalhealth.gov", "betterhelp.com", "verywellmind.com", "healthline.com", "headtohealth.gov.au", "depression.ch", "promente.at", "seelsorge.net",
        "psy.ch", "psychenet.de",
    ),
    "crisis": ("988lifeline.org", "samiritans.org", "samaritans.org", "be-friending.org", "telefonseelsorge.de", "befrienders.org", "crisistextline.org", "telefonseelsorge.at", "143.ch", "147.ch"),
    "therapy": (
        "psychologytoday.com", "zocdoc.com", "therapyroute.com", "goodtherapy.org", "therapie.de", "psychotherapiesuche.de", "psychotherapie.at", "psychotherapie.ch", "doctolib.de", "doctolib.at",
        "doktor.ch",
    ),
    "cloud": ("drive.google.com", "dropbox.com", "icloud.com", "box.com", "onedrive.live.com"),
}

#: Patterns on queries and addresses, matched without regard to case.
PATTERNS: dict[str, str] = {
    "negative_self": r"(am\+?i\+?(?:worthless|useless|a\+?burden)|i\+?hate\+?myself|why\+?am\+?i\+?useless)",
    "method": r"(painless\+?suicide|how\+?to\+?hang|end\+?my\+?life|overdose\+?mg|helium\+?suicide|jump\+?off\+?bridge|suicide\+?methods?)",
    "forum": r"(/r/suicidewatch|/r/selfharm|/r/depression|/suicidewatch|/selfharm)",
    "account": r"(delete[_-]?account|unsubscribe)",
    "settings": r"/(settings|privacy)",
    "will": r"(estate|last-?will|testament|insurance).*\.pdf",
}

#: Private IPv4 ranges (first, last) and the two public addresses inside one of them.
PRIVATE_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
)
PUBLIC_INSIDE = ("192.0.0.9", "192.0.0.10")
