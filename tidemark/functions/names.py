"""What readers see in place of keys: visitors' names of a day, places by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that names depend on: four words for each of 24 letters, in letter order.
ADJECTIVES = """
Amiable Astonished Affable Airy Bashful Breezy Beaming Brisk Cheerful Curious Chipper Canny Dapper Dreamy Dauntless Diligent Eager Exuberant Earnest Easygoing
Fanciful Frolicsome Fearless Friendly Genial Gleeful Gallant Graceful Hopeful Humble Hearty Helpful Inquisitive Intrepid Inventive Idyllic Jaunty Jovial Jubilant Just
Keen Kindly Knowing Kinetic Lively Luminous Lucky Limber Mellow Merry Mindful Mirthful Nimble Noble Neighborly Nifty Observant Optimistic Obliging Onward
Peppy Plucky Patient Placid Radiant Rambunctious Resolute Restful Serene Spirited Sunny Steadfast Thoughtful Tranquil Tidy Tenacious Unhurried Upbeat Unruffled Untiring
Velvety Vivacious Valiant Verdant Whimsical Wistful Winsome Wandering Yawning Youthful Yearning Yielding Zany Zesty Zealous Zippy
""".split()
ANIMALS = """
Aardvark Albatross Axolotl Antelope Badger Bumblebee Bandicoot Bittern Capybara Chinchilla Cormorant Chipmunk Dormouse Duckling Dingo Dragonfly Echidna Ermine Egret Eider
Ferret Firefly Finch Fennec Gazelle Gecko Godwit Grebe Hedgehog Hummingbird Heron Hare Ibex Iguana Impala Ibis Jackrabbit Jellyfish Jacana Jerboa
Kingfisher Kiwi Kestrel Koala Lemur Lynx Lapwing Loon Marmot Meerkat Manatee Magpie Narwhal Nightingale Numbat Nuthatch Ocelot Otter Osprey Oriole
Pangolin Puffin Plover Porcupine Raccoon Reindeer Roadrunner Redstart Salamander Squirrel Sandpiper Serval Tapir Toucan Tamarin Teal Uakari Urchin Umbrellabird Uguisu
Vicuna Vole Vireo Viscacha Wallaby Wombat Wagtail Weasel Yak Yellowhammer Yabby Yearling Zebra Zebrafish Zorilla Zorro
""".split()
WORDS, COLORS, DAY_MS = 4, 3, 86_400_000


def visitor_name(visitor: Column, ts: Column) -> dict[str, Column]:
    """Columns name and color of a visitor key (hexadecimal) on the UTC day of ts: two words of one letter, and 0 to 2.

    Names collide and are for reading only; rows are told apart by visitor_ref(). Null without a key or a time; a key
    that isn't hexadecimal has no name.
    """
    day = F.floor(ts / DAY_MS).cast("string")
    digest = F.sha2(F.concat(F.encode(F.concat(day, F.lit("\n")), "UTF-8"), F.unhex(visitor)), 256)
    byte = lambda n: F.conv(F.substring(digest, 2 * n + 1, 2), 16, 10).cast("int")
    letter, first, second = byte(0) % (len(ADJECTIVES) // WORDS), byte(1) % WORDS, byte(2) % WORDS
    word = lambda words, n: F.get(F.array(*map(F.lit, words)), letter * WORDS + n)
    return {"name": F.concat(word(ADJECTIVES, first), F.lit(" "), word(ANIMALS, second)), "color": ((letter * WORDS + first) * WORDS + second) % COLORS}


def visitor_ref(visitor: Column, salt: str) -> Column:
    """Twelve digits that stand for a visitor as long as the salt, hexadecimal, is kept, and tell nothing after."""
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(salt)), F.unhex(visitor)), 256), 1, 12)


def with_names(rows: DataFrame, column: str, names: DataFrame, to: str) -> DataFrame:
    """rows with column `to`: the name of the code in `column`, in any case; what has none shows as its code, and null as null.

    names: code, name; of names of one code the smallest stands. A dimension table, left to Spark to broadcast by its size.
    """
    known = names.groupBy(F.upper("code").alias("__code")).agg(F.min("name").alias("__shown"))
    return rows.join(known, F.upper(F.col(column)) == F.col("__code"), "left").withColumn(to, F.coalesce("__shown", F.col(column))).drop("__code", "__shown")
