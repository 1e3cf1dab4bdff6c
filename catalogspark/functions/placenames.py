"""Place phrases in folder and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alower, col, has_cjk, let

# fixed values: phrases that never name a place
STOP_PHRASES = """img|image|images|photo|photos|picture|pictures|pics|pic|dcim|camera|camera roll|cameraroll|screenshot|screenshots|screen shots|
screen|download|downloads|desktop|documents|backup|backups|export|exports|exported|edited|edit|edits|original|originals|new folder|untitled|
untitled folder|misc|other|others|temp|tmp|wallpaper|wallpapers|whatsapp|whatsapp images|whatsapp image|wechat|weixin|telegram|instagram|facebook|
snapchat|messenger|line|qq|iphone|ipad|android|samsung|xiaomi|huawei|oppo|vivo|pixel|google|apple|icloud|icloud photos|dropbox|onedrive|
google photos|drive|sd card|sdcard|card|raw|jpg|jpeg|heic|png|video|videos|movie|movies|mobile|phone|gallery|album|albums|media|user|users|home|
mnt|volumes|data|share|shared|public|private|me|mine|my photos|my pictures|all|all photos|selected|best|favorites|favourites|import|imported|
imports|upload|uploads|camera uploads|snapseed|lightroom|photoshop|vsco|burst|portrait|selfie|selfies|panorama|pano|thumbnails|thumbs|cache|sent|
received|restored|recovered|copy|mmexport|wx_camera|microsoft|windows|library|photos library|masters|previews|resources|canon|nikon|sony|fuji|
fujifilm|olympus|panasonic|leica|gopro|dji|ricoh|pentax|lumix|eos|src|source|sources|input|output|out|in|test|tests|new|old|files|file|folder|
folders|stuff|archive|archives|sort|sorted|unsorted|todo|done|work|照片|相片|图片|相册|相机|截图|截屏|屏幕截图|新建文件夹|下载|桌面|备份|导出|微信|
微信图片|手机|全部|其他|未命名|我的照片|壁纸|视频|原图|精选|收藏|文档""".replace("\n", "").split("|")

# fixed values: leading tokens cameras and apps write
CAMERA_TOKEN = (r"^(img|dsc|dscn|dscf|dsci|pxl|mvimg|vid|pano|burst|sam|cimg|imag|kimg|dji|gopr|gp|gh|p|pict|dcp|mvc|wa|mmexport|wx_camera|screenshot|"
                r"photo|image|mms|received|snapchat|fb_img|signal|trim|edit|copy|[0-9]{3}[a-z_]{5})$")
CAMERA_FOLDER = r"^[0-9]{3}[A-Za-z0-9_]{5}$"
# fixed values: words of names that say nothing
NOISE_WORDS = ["img", "image", "images", "photo", "photos", "picture", "pictures", "pics", "dcim", "camera", "screenshot", "screenshots", "copy", "edited", "export"]

# fixed values: trip words after a place, in the order they are tried
TRIP_AFFIXES = [" day trip", " road trip", " trip", " travels", " travel", " vacation", " holidays", " holiday", " tour", " visit", " journey",
                " getaway", " weekend", "自驾游", "一日游", "之旅", "旅行", "旅游", "游玩", "游记", "自驾", "出差", "行", "游"]
TRIP_LEAD = r"(?i)^(trip to|travel to|visit to|visit|vacation in|holiday in|in) (.+)$"
DATE_RUN = r"((19|20)[0-9]{2}([-_. ]?[0-9]{1,2}){0,2}(年|月|日)?)|([0-9]+)|(年|月|日)"


def phrases(name) -> Column:
    """The phrases of a name once dates, numbers and separators are gone; single spaces stay inside a phrase."""
    s = F.regexp_replace(F.regexp_replace(col(name), DATE_RUN, "|"), r"[_\-/\\,;()\[\]{}+&#@!~=|.、，（）【】·]", "|")
    parts = F.transform(F.split(s, r"\|"), lambda p: F.regexp_replace(F.trim(p), " {2,}", " "))
    return F.filter(parts, lambda p: p != "")


def is_stop_phrase(p) -> Column:
    return alower(p).isin(STOP_PHRASES)


def content_phrase(p) -> Column:
    """A phrase without camera tokens and photo words."""
    words = F.filter(F.split(col(p), " "), lambda w: (w != "") & ~alower(w).rlike(CAMERA_TOKEN) & ~alower(w).isin(NOISE_WORDS))
    return F.array_join(words, " ")


def strip_trip_words(p) -> Column:
    """``struct<text, cue>``: the phrase without its trip word, and whether it had one."""
    text = col(p)
    low = alower(text)
    out = F.struct(F.coalesce(F.when(text.rlike(TRIP_LEAD), F.regexp_extract(text, TRIP_LEAD, 2)), text).alias("text"), text.rlike(TRIP_LEAD).alias("cue"))
    for a in reversed(TRIP_AFFIXES):
        rest = F.trim(F.left(text, F.length(text) - len(a)))
        ok = F.endswith(low, F.lit(a)) & (F.length(text) > len(a)) & (rest != "")
        if len(a) == 1:  # a one-character suffix needs a word before it
            ok = ok & (F.char_length(rest) >= 2)
        out = F.when(ok, F.struct(rest.alias("text"), F.lit(True).alias("cue"))).otherwise(out)
    return out


def usable_phrase(p) -> Column:
    t = col(p)
    letters = F.octet_length(F.regexp_replace(t, r"[^A-Za-z\x{80}-\x{10FFFF}]", ""))
    plain = F.char_length(t).between(3, 40) & (letters >= 3)
    return ~is_stop_phrase(t) & ~alower(t).rlike(CAMERA_TOKEN) & F.when(has_cjk(t), F.char_length(t).between(2, 16)).otherwise(plain)


CANDIDATE = "struct<text:string,origin:string,level:int,cue:boolean,prior:double>"
MAX_CANDIDATES = 19  # fixed value: options the second opinion can take besides "none"


def place_candidates(dirs, file_stem=None) -> Column:
    """Place phrases of the nearest three folders and the file name, with their prior."""
    origins = F.transform(F.slice(col(dirs), F.lit(1), F.lit(3)), lambda d, i: F.struct(d.alias("o"), i.alias("l")))
    if file_stem is not None:
        origins = F.concat(origins, F.array(F.struct(col(file_stem).alias("o"), F.lit(-1).alias("l"))))
    origins = F.filter(origins, lambda o: ~o["o"].rlike(CAMERA_FOLDER))

    def of(o):
        return F.transform(F.filter(phrases(o["o"]), lambda p: ~is_stop_phrase(p)), lambda p: let(content_phrase(p), lambda c: let(
            strip_trip_words(c), lambda s: F.struct(s["text"].alias("text"), o["o"].alias("origin"), o["l"].alias("level"), s["cue"].alias("cue")))))

    found = F.filter(F.flatten(F.transform(origins, of)), lambda c: usable_phrase(c["text"]))

    def merge(all_):
        keys = F.transform(all_, lambda c: alower(c["text"]))
        firsts = F.filter(all_, lambda c, i: F.array_position(keys, alower(c["text"])) == i + 1)
        level = lambda c: F.when(c["level"] == 0, 0.35).when(c["level"] == 1, 0.30).when(c["level"] == 2, 0.25).otherwise(0.20)
        cue = lambda c: F.exists(all_, lambda o: o["cue"] & (alower(o["text"]) == alower(c["text"])))
        return F.slice(F.transform(firsts, lambda c: F.struct(
            c["text"].alias("text"), c["origin"].alias("origin"), c["level"].alias("level"), cue(c).alias("cue"),
            F.least(F.lit(0.95), level(c) + F.when(cue(c), 0.35).otherwise(0.0)).alias("prior")).cast(CANDIDATE)), F.lit(1), F.lit(MAX_CANDIDATES))

    return let(found, merge)


def rules_scores(cands) -> Column:
    """The best-scored candidate carries its prior; the others share what is left in proportion."""
    best = F.array_max(F.transform(col(cands), lambda c: c["prior"]))
    return let(best, lambda b: F.transform(col(cands), lambda c: F.when(c["prior"] >= b, c["prior"]).otherwise(c["prior"] * (1 - b) * 0.5)))


def match_answer(cands, answer) -> Column:
    """0-based position of the candidate a free-text answer means, or -1: equal first, then contained either way."""
    a = alower(F.trim(col(answer)))
    same = F.array_position(F.transform(col(cands), lambda c: alower(c["text"])), a).cast("int") - 1
    near = F.array_position(F.transform(col(cands), lambda c: F.contains(alower(c["text"]), a) | F.contains(a, alower(c["text"])) | F.contains(alower(c["origin"]), a)), True).cast("int") - 1
    return F.when(a.isNull() | a.isin("", "none", "null"), -1).when(same >= 0, same).otherwise(F.coalesce(near, F.lit(-1)))
