"""Hand-traced canonicaliser cases: (manufacturer, raw model, after walk, after alias)."""

CASES = [
    ("toyota", "Camry LE", "camry", "camry"),
    (" Toyota ", "4 Runner SR5", "4 runner", "4runner"),
    ("toyota", "rav4 xle awd", "rav4", "rav4"),
    ("toyota", "mr-2", "mr-2", "mr2"),
    ("toyota", "MR2", "mr2", "mr2 spyder"),
    ("toyota", "prius v three", "prius v", "prius v"),
    ("honda", "2014 accord EX-L V6", "accord", "accord"),
    ("honda", "cr v ex", "cr v", "cr-v"),
    ("honda", "civic type r", "civic", "civic"),
    ("HONDA", "CRV", "crv", "cr-v"),
    ("ford", "f150 lariat", "f150", "f-150"),
    ("ford", "f-150 xlt (clean title)", "f-150", "f-150"),
    ("ford", "super duty f-250", "f-250", "f-250"),
    ("ford", "500", "500", "five hundred"),
    ("ram", "1500", "", ""),
    ("ram", "1500 big horn", "big horn", "1500"),
    ("ram", "2500 hd", "hd", "hd"),
    ("ram", "pickup 1500", "pickup 1500", "1500"),
    ("bmw", "328i xdrive", "328i", "3 series"),
    ("bmw", "3-series", "3-series", "3 series"),
    ("bmw", "x5 xdrive35i", "x5", "x5"),
    ("lexus", "es350", "es350", "es 350"),
    ("lexus", "rx 350 f sport", "rx 350", "rx 350"),
    ("lexus", "es 300h", "es 300h", "es 300h"),
    ("mercedes-benz", "benz c300", "c300", "c 300"),
    ("mercedes-benz", "c-class c 300", "c 300", "c 300"),
    ("mercedes-benz", "gle-class", "", ""),
    ("mercedes-benz", "ml350", "ml350", "ml 350"),
    ("mazda", "cx-30 select", "cx-3", "cx-3"),
    ("mazda", "3 i touring", "3", "mazda3"),
    ("chrysler", "town & country touring", "town", "town & country"),
    ("chrysler", "300c", "300c", "300"),
    ("chevrolet", "suburban 1500 lt", "suburban 1500", "suburban"),
    ("chevrolet", "silverado", "silverado", "silverado 1500"),
    ("chevrolet", "2500 hd", "hd", "silverado 2500"),
    ("volvo", "certified", "certified", ""),
    ("volvo", "xc90 t6", "xc90", "xc90"),
    ("mini", "cooper s", "s", "hardtop"),
    ("mini", "cooper countryman", "countryman", "countryman"),
    ("rover", "rover range rover sport", "range rover sport", "range rover sport"),
    ("alfa-romeo", "romeo giulia ti", "giulia", "giulia"),
    ("harley-davidson", "davidson", "", ""),
    ("subaru", "impreza wrx sti", "impreza wrx sti", "wrx sti"),
    ("jeep", "wrangler unlimited sahara", "wrangler unlimited", "wrangler unlimited"),
    ("nissan", "rouge sv", "rouge", "rogue"),
    ("nissan", "altima 2.5 s", "altima", "altima"),
    ("gmc", "sierra denali", "sierra", "sierra 1500"),
    ("dodge", "grand", "grand", "grand caravan"),
    ("tesla", "model 3 long range", "model 3", "model 3"),
    ("tesla", "s", "s", "model s"),
    ("kia", "lifted sportage lx", "sportage", "sportage"),
    ("hyundai", "(one owner) 2014 elantra", "elantra", "elantra"),
    ("acura", "mdx tech", "mdx", "mdx"),
    ("unknownco", "superlongname x", "superlongname x", "superlongname x"),
    ("audi", "a4 2.0t premium", "a4", "a4"),
    ("infiniti", "g 37 coupe", "g", "g37"),
    ("volkswagen", "golf gti s", "golf gti", "gti"),
    ("pontiac", "grand prix gt", "grand prix", "grand prix"),
]
