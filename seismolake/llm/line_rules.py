"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes with them.

All of it is Spark's own functions over the rows in place: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, held, numbered, words

# Characters that count as symbols.
SYMBOL_CLASS = r"[#*$%&|<>]"
# Phrases of navigation and of boilerplate, as alternatives of one pattern each.
# English, German, French and Spanish ones, by language.
NAVIGATION = "|".join((
    "home|about us|contact us|log ?in|log ?out|sign in|sign up|menu|site ?map|skip to (main )?content|back to top|read more|click here|next page|previous page|share this|follow us|page [0-9]+ of [0-9]+",
    "startseite|über uns|kontakt|anmelden|abmelden|registrieren|menü|inhaltsverzeichnis|zum inhalt( springen)?|nach oben|zurück zur übersicht|mehr lesen|weiterlesen|hier klicken|nächste seite|vorherige seite|teilen|folgen sie uns|seite [0-9]+ von [0-9]+",
    "accueil|à propos|contactez-nous|se connecter|connexion|se déconnecter|s'inscrire|plan du site|aller au contenu( principal)?|haut de page|retour en haut|lire la suite|en savoir plus|cliquez ici|page suivante|page précédente|partager|suivez-nous|page [0-9]+ sur [0-9]+",
    "inicio|quiénes somos|sobre nosotros|contáctenos|contacto|iniciar sesión|cerrar sesión|regístrate|menú|mapa del sitio|saltar al contenido|volver arriba|leer más|seguir leyendo|haga clic aquí|haz clic aquí|página siguiente|página anterior|compartir|síguenos|página [0-9]+ de [0-9]+",
))
BOILERPLATE = "|".join((
    "all rights reserved|privacy policy|terms of (use|service)|terms and conditions|cookie policy|(uses?|accept|enable) cookies|enable javascript|lorem ipsum|subscribe to our newsletter|powered by|copyright (©|\\(c\\)|[0-9]{4})",
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|impressum|(verwendet|akzeptieren|aktivieren) cookies|cookies (akzeptieren|zulassen)|javascript aktivieren|newsletter abonnieren",
    "tous droits réservés|politique de confidentialité|conditions (générales|d'utilisation)|mentions légales|(utilise des|accepter les) cookies|activer javascript|abonnez-vous à notre newsletter|propulsé par",
    "todos los derechos reservados|política de privacidad|política de cookies|términos (de uso|y condiciones)|aviso legal|(utiliza|aceptar) cookies|activar javascript|suscríbete a nuestro boletín|desarrollado por",
))
#: Characters of a line that navigation or boilerplate may fill; share of a line's characters that symbols may be.
BRIEF, SYMBOL_SHARE = 120, 0.2
#: A document goes if its lines lose more than this share of its word characters.
MOST_LOST = 0.5
# Fixed values of the base rules: fewest words, and the percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails: up to four words without an end mark, navigation, boilerplate, or too many symbols."""
    ended = line.rlike(r"""[.!?:;…。！？"'”’»)\]]\s*$""")
    unended = ~ended & line.rlike(r"^\s*\S+(\s+\S+){0,3}\s*$")
    navigation = line.rlike(r"( [|»›•·] .*){2,}") | line.rlike(rf"(?iuU)^\W*({NAVIGATION})\b") & ~ended
    boilerplate = line.rlike(rf"(?iuU)\b({BOILERPLATE})")
    marked = F.length(F.regexp_replace(line, SYMBOL_CLASS, "")) < (1 - SYMBOL_SHARE) * F.length(line)
    return unended | (F.length(line) <= BRIEF) & (navigation | boilerplate) | marked


def repeated_words(grams: str, ordered: str) -> Column:
    """Words in three-word windows that occur twice or more; ordered: the windows with their places, sorted, or null if all differ."""
    gram = lambda k: F.get(F.col(ordered), k)["gram"]
    twice = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda k: (gram(k) == F.coalesce(gram(k - 1), F.lit(""))) | (gram(k) == F.coalesce(gram(k + 1), F.lit(""))))
    places = F.sort_array(F.transform(twice, lambda k: F.get(F.col(ordered), k)["at"]))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, at: F.struct(at.alias("last"), (s["n"] + F.least(F.lit(3), at - s["last"])).alias("n")), lambda s: s["n"])
    return F.when(F.col(ordered).isNull(), 0).otherwise(covered)


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (text, any other columns) with `quality`: a struct of counts, verdicts and the cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines (with a word),
    n_failed_lines, lost (share of word characters in failing lines), kept, cleaned (the text without
    its failing lines). Null and empty texts have no words: base_failed, not kept, lost 0, cleaned as the text.
    Each row is judged alone, so repeated rows, ties and other columns change nothing.
    """
    own, row = numbered(docs)
    text = F.coalesce(F.col(f"_{docs.columns.index('text')}"), F.lit(""))
    step = held(own.withColumn("t", text), w=words(F.col("t")), all_lines=F.split("t", "\n"))
    n = F.size("w")
    word = lambda k: F.get(F.col("w"), k)
    none = F.array().cast("array<string>")
    # Hashes tell most texts, whose windows all differ, from those worth the exact comparison.
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.xxhash64(word(k), word(k + 1), word(k + 2)))
    step = held(step, hashes=F.when(n >= 4, hashes).otherwise(F.array().cast("array<bigint>")))
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.concat(word(k), F.lit(" "), word(k + 1), F.lit(" "), word(k + 2)))
    step = held(step, grams=F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), grams).otherwise(none)).drop("hashes")
    sorted_grams = F.sort_array(F.transform("grams", lambda x, at: F.struct(x.alias("gram"), at.alias("at"))))
    step = held(step, ordered=F.when(F.size("grams") > 0, sorted_grams))
    step = held(
        step,
        repeats=repeated_words("grams", "ordered"),
        lines=F.filter("all_lines", has_word),
        good=F.filter("all_lines", lambda x: ~has_word(x) | ~line_fails(x)),
    ).drop("grams", "ordered")
    step = held(step, cleaned=F.when(F.size("good") == F.size("all_lines"), F.col("t")).otherwise(F.array_join("good", "\n")), solid=F.length(F.array_join("w", "")))
    left = F.length(F.regexp_replace("cleaned", SPACE_CLASS, ""))
    step = step.withColumns({
        "lost": F.when((F.col("solid") > 0) & (F.size("good") < F.size("all_lines")), 1 - left / F.col("solid")).otherwise(0.0),
        "base_failed": (n < least_words) | (100 * F.col("repeats").cast("long") > MOST_REPEATED * n),
    })
    failed = F.size("all_lines") - F.size("good")  # lines without a word never fail
    quality = F.struct(
        n.cast("long").alias("n_words"), F.col("solid").cast("long").alias("word_chars"), (F.length("t") - F.length(F.regexp_replace("t", SYMBOL_CLASS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.col("repeats").cast("long").alias("n_repeat_words"), "base_failed",
        F.size("lines").cast("long").alias("n_lines"), failed.cast("long").alias("n_failed_lines"), "lost",
        (~F.col("base_failed") & (F.col("lost") <= most_lost)).alias("kept"), "cleaned",
    )
    return held(step, quality=quality).select(row, "quality")


def keep_clean(docs: DataFrame, most_lost: float = MOST_LOST, least_words: int = 1) -> DataFrame:
    """The documents that the rules keep, with the columns of docs; text without its failing lines, n_chars, if there, of that text.

    A document goes if its failing lines hold more than most_lost of it, if over half of its words lie in repeated windows, or if it has fewer than
    least_words words: short documents stay, null, empty and blank ones go. Each row is judged alone, so repeated
    rows stay repeated; other columns are carried, whatever their names.
    """
    kept = clean_lines(docs, most_lost, least_words).where("quality.kept")
    new = {"text": F.col("quality.cleaned"), "n_chars": F.length("quality.cleaned").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
