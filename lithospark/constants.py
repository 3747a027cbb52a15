"""Fixed values of the container formats."""

# Names of standard entries by id.
ENTRY_NAMES = {
    0x400: "license.dat",
    0x401: "license.info",
    0x402: "nptitle.dat",
    0x403: "npbind.dat",
    0x404: "selfinfo.dat",
    0x406: "imageinfo.dat",
    0x408: "origin-deltainfo.dat",
    0x409: "psreserved.dat",
    0x1000: "param.sfo",
    0x1001: "playgo-chunk.dat",
    0x1002: "playgo-chunk.sha",
    0x1003: "playgo-manifest.xml",
    0x1004: "pronunciation.xml",
    0x1005: "pronunciation.sig",
    0x1006: "pic1.png",
    0x1008: "app/playgo-chunk.dat",
    0x100B: "shareparam.json",
    0x100C: "shareoverlayimage.png",
    0x100D: "save_data.png",
    0x1200: "icon0.png",
    0x1220: "pic0.png",
    0x1240: "snd0.at9",
    0x1260: "changeinfo/changeinfo.xml",
    0x1280: "icon0.dds",
    0x12A0: "pic0.dds",
    0x12C0: "pic1.dds",
    0x1400: "trophy/trophy00.trp",
}

# Ids of entries that hold tables and not files.
META_ENTRY_IDS = [0x1, 0x10, 0x20, 0x80, 0x100, 0x200]

# System files that a packager makes itself.
MANAGED_FILES = [
    "sce_sys/icon0.dds",
    "sce_sys/pic0.dds",
    "sce_sys/pic1.dds",
    "sce_sys/license.dat",
    "sce_sys/license.dat.encrypted",
    "sce_sys/license.info",
    "sce_sys/license.info.encrypted",
    "sce_sys/playgo-chunk.dat",
    "sce_sys/playgo-chunk.sha",
    "sce_sys/playgo-manifest.xml",
    "sce_sys/app/playgo-chunk.dat",
    "sce_sys/psreserved.dat",
]

# Classes of trophy files, in the order of a listing.
TROPHY_PATTERNS = [
    r"(?i)^TROPCONF\.(E?SFM)$",
    r"(?i)^TROP\.(E?SFM)$",
    r"(?i)^TROP_\d+\.(E?SFM)$",
    r"(?i)^ICON0\.PNG$",
    r"(?i)^ICON0_\d+\.PNG$",
    r"(?i)^GR\d+\.PNG$",
    r"(?i)^GR\d+_\d+\.PNG$",
    r"(?i)^TROP\d+\.PNG$",
]

# Categories, and content types that stand in for them.
CATEGORY_TYPES = {"gd": "Game", "gp": "Patch", "th": "Theme", "av": "Avatar", "wa": "Wallpaper"}
ADDON_CATEGORIES = ["ac", "al"]
CONTENT_TYPES = {0x1A: "Game", 0x1E: "Patch"}
THEME_PREFIXES = ["ip9100", "ip9102", "ip9104"]

# Columns of a sweep report.
SWEEP_COLUMNS = ["File", "Result", "Type", "Title", "TitleId", "ContentId", "Category", "Passcode", "Error"]

# System files that a packager makes anew.
REMADE_FILES = ["license.dat", "license.info", "psreserved.dat", "playgo-chunk.dat", "playgo-chunk.sha", "playgo-manifest.xml"]

# Fields of an image header that a comparison shows.
IMAGE_FIELDS = ["version", "mode", "block_size", "nblock", "dinode_count", "ndblock", "dinode_block_count"]

# Files a rebuild needs.
KEY_FILES = ["eboot.bin", "sce_sys/param.sfo", "sce_sys/keystone"]

# Sizes, magics and alignments.
BLOCK = 0x10000
PKG_MAGIC = 0x7F434E54
PFS_MAGIC = 20130315
PFSC_MAGIC = b"PFSC"
SFO_MAGIC = b"\x00PSF"
TRP_MAGIC = 0xDCA24D00
IMAGE_ALIGN = 0x80000
PACKAGE_ALIGN = 0x8000
ENTRY_ALIGN = 16
HASH_SLOT_INODE_BITS = 28
INODE_SIZE = 0xA8
SIGNED_INODE_SIZE = 0x2C8
WIDE_SIGNED_INODE_SIZE = 0x310
DEFLATE_HEADER = b"\x48\x89"
ADLER_BASE = 65521
SFO_FORMATS = {0x0204: "utf8", 0x0004: "utf8-special", 0x0404: "int32"}
SPACE_RESERVE = 256 * 1024 * 1024
STRUCTURAL_INODES = 3
SYSTEM_ENTRIES = 13
