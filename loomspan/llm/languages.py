"""The language of a sentence: its script, and within Latin script a character n-gram scorer.

The scorer is naive Bayes over the trigrams of words. It is fitted on a few sentences of
each language and its margins are calibrated on the same sentences, each scored by a
scorer that hasn't seen it, and in pieces: the shorter the piece, the wider the margin.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import regex

#: Texts to fit on, our own; ordinary words in ordinary sentences.
TEXTS = {
    "en": "The old house at the end of the street was sold to a family who had lived abroad for years. She told him that they would not be able to come before the summer. There is no reason to believe that this will change soon. How many of these letters did he keep, and where are they now? What happened to the people who were left behind when the water rose? It was said to have been written by two brothers, but nobody knows which of them. In which year did the council decide that the bridge should be closed? We have to ask whether any of it can be used again. According to the report, the work was finished with the help of several others, about three weeks later than planned. Who was responsible for this, and why did it take so long? This returns the first value that is not empty, and it calls another function for each item in the list. They described how the machine had been built, tested and repaired from time to time. Does it depend on the size of the input? As far as I know, both were named after the same town.",
    "de": "Das alte Haus am Ende der Straße wurde an eine Familie verkauft, die viele Jahre im Ausland gelebt hatte. Sie sagte ihm, dass sie vor dem Sommer nicht kommen könnten. Es gibt keinen Grund zu glauben, dass sich das bald ändern wird. Wie viele dieser Briefe hat er behalten, und wo sind sie jetzt? Was geschah mit den Leuten, die zurückgeblieben sind, als das Wasser stieg? Es soll von zwei Brüdern geschrieben worden sein, aber niemand weiß, von welchem. In welchem Jahr hat der Rat beschlossen, die Brücke zu schließen? Wir müssen fragen, ob etwas davon noch einmal verwendet werden kann. Laut dem Bericht wurde die Arbeit mit Hilfe einiger anderer beendet, etwa drei Wochen später als geplant. Wer war dafür zuständig, und warum hat es so lange gedauert? Das gibt den ersten Wert zurück, der nicht leer ist, und ruft für jeden Eintrag der Liste eine weitere Funktion auf. Sie haben beschrieben, wie die Maschine gebaut, geprüft und von Zeit zu Zeit repariert worden war. Hängt es von der Größe der Eingabe ab? Soweit ich weiß, sind beide nach derselben Stadt benannt und dazu kamen weitere hinzu.",
    "fr": "La vieille maison au bout de la rue a été vendue à une famille qui avait vécu plusieurs années à l'étranger. Elle lui a dit qu'ils ne pourraient pas venir avant l'été. Il n'y a aucune raison de croire que cela va bientôt changer. Combien de ces lettres a-t-il gardées, et où sont-elles maintenant ? Qu'est-il arrivé aux gens qui sont restés quand l'eau est montée ? On dit que cela a été écrit par deux frères, mais personne ne sait lequel. En quelle année le conseil a-t-il décidé de fermer le pont ? Nous devons demander si une partie peut encore servir. Selon le rapport, le travail a été terminé avec l'aide de plusieurs autres, environ trois semaines plus tard que prévu. Qui en était responsable, et pourquoi cela a-t-il pris autant de temps ? Cette fonction renvoie la première valeur qui n'est pas vide et en appelle une autre pour chaque élément de la liste. Ils ont décrit comment la machine avait été construite, essayée et réparée de temps en temps. D'après les notes de ce dossier, tous les deux portent le nom de la même ville, dans les mêmes pièces.",
    "es": "La casa vieja al final de la calle fue vendida a una familia que había vivido muchos años en el extranjero. Ella le dijo que no podrían venir antes del verano. No hay ninguna razón para creer que esto vaya a cambiar pronto. ¿Cuántas de estas cartas guardó, y dónde están ahora? ¿Qué pasó con la gente que se quedó cuando subió el agua? Se dice que fue escrito por dos hermanos, pero nadie sabe cuál de ellos. ¿En qué año decidió el consejo cerrar el puente? Tenemos que preguntar si algo de eso se puede usar otra vez. Según el informe, el trabajo se terminó con la ayuda de varios otros, unas tres semanas más tarde de lo previsto. ¿Quién era el responsable, y por qué tardó tanto? Esta función devuelve el primer valor que no está vacío y llama a otra para cada elemento de la lista. Ellos describieron cómo la máquina había sido construida, probada y reparada de vez en cuando. Dejó también sus notas cerca de aquí, junto con las demás, y los dos llevan el nombre de la misma ciudad cuando es posible.",
    "it": "La vecchia casa in fondo alla strada è stata venduta a una famiglia che aveva vissuto per molti anni all'estero. Lei gli disse che non sarebbero potuti venire prima dell'estate. Non c'è nessuna ragione di credere che questo cambierà presto. Quante di queste lettere ha conservato, e dove sono adesso? Che cosa è successo alla gente che è rimasta quando l'acqua è salita? Si dice che sia stato scritto da due fratelli, ma nessuno sa da quale. In quale anno il consiglio ha deciso di chiudere il ponte? Dobbiamo chiedere se qualcosa può essere usato ancora. Secondo il rapporto, il lavoro è stato finito con l'aiuto di molti altri, circa tre settimane più tardi del previsto. Chi ne era responsabile, e perché ci è voluto così tanto? Questa funzione restituisce il primo valore che non è vuoto e ne chiama un'altra per ogni elemento della lista. Hanno descritto come la macchina era stata costruita, provata e riparata di tanto in tanto. Nelle note degli altri si legge che entrambi hanno il nome della stessa città, insieme con quelli nuovi.",
    "pt": "A casa velha no fim da rua foi vendida a uma família que tinha vivido muitos anos no estrangeiro. Ela disse-lhe que não poderiam vir antes do verão. Não há nenhuma razão para acreditar que isso vá mudar em breve. Quantas destas cartas guardou ele, e onde estão agora? O que aconteceu às pessoas que ficaram quando a água subiu? Diz-se que foi escrito por dois irmãos, mas ninguém sabe por qual deles. Em que ano decidiu o conselho fechar a ponte? Temos de perguntar se alguma coisa disso ainda pode ser usada. Segundo o relatório, o trabalho foi terminado com a ajuda de vários outros, cerca de três semanas mais tarde do que o previsto. Quem era o responsável, e por que demorou tanto tempo? Esta função devolve o primeiro valor que não está vazio e chama outra para cada elemento da lista. Eles descreveram como a máquina tinha sido construída, testada e reparada de vez em quando. Deixou também as suas notas junto com as demais, e os dois têm o nome da mesma cidade quando é possível.",
    "nl": "Het oude huis aan het einde van de straat werd verkocht aan een gezin dat jarenlang in het buitenland had gewoond. Ze zei hem dat ze niet voor de zomer zouden kunnen komen. Er is geen reden om te geloven dat dit gauw zal veranderen. Hoeveel van deze brieven heeft hij bewaard, en waar zijn ze nu? Wat is er gebeurd met de mensen die achterbleven toen het water steeg? Men zegt dat het door twee broers is geschreven, maar niemand weet door wie van hen. In welk jaar besloot de raad dat de brug gesloten moest worden? We moeten vragen of er iets van opnieuw gebruikt kan worden. Volgens het verslag werd het werk afgemaakt met de hulp van enkele anderen, ongeveer drie weken later dan gepland. Wie was daarvoor verantwoordelijk, en waarom duurde het zo lang? Dit geeft de eerste waarde terug die niet leeg is, en roept voor elk onderdeel van de lijst een andere functie aan. Zij beschreven hoe de machine was gebouwd, getest en af en toe hersteld. Voor zover ik weet zijn beide naar dezelfde stad genoemd, en er waren nog meer bij.",
    "pl": "Stary dom na końcu ulicy został sprzedany rodzinie, która przez wiele lat mieszkała za granicą. Powiedziała mu, że nie będą mogli przyjechać przed latem. Nie ma powodu, aby wierzyć, że to się wkrótce zmieni. Ile z tych listów zachował i gdzie one teraz są? Co się stało z ludźmi, którzy zostali, kiedy woda się podniosła? Podobno napisali to dwaj bracia, ale nikt nie wie, który z nich. W którym roku rada postanowiła zamknąć most? Musimy zapytać, czy coś z tego może być jeszcze użyte. Według raportu praca została ukończona z pomocą kilku innych, około trzy tygodnie później niż planowano. Kto był za to odpowiedzialny i dlaczego trwało to tak długo? Ta funkcja zwraca pierwszą wartość, która nie jest pusta, i wywołuje inną dla każdego elementu listy. Opisali, jak maszyna była budowana, badana i od czasu do czasu naprawiana.",
    "sv": "Det gamla huset i slutet av gatan såldes till en familj som hade bott utomlands i många år. Hon sade till honom att de inte skulle kunna komma före sommaren. Det finns inget skäl att tro att detta snart kommer att förändras. Hur många av dessa brev behöll han, och var är de nu? Vad hände med människorna som blev kvar när vattnet steg? Det sägs ha skrivits av två bröder, men ingen vet vilken av dem. Vilket år beslutade rådet att bron skulle stängas? Vi måste fråga om något av det kan användas igen. Enligt rapporten blev arbetet färdigt med hjälp av flera andra, ungefär tre veckor senare än planerat. Vem var ansvarig för detta, och varför tog det så lång tid? Den returnerar det första värdet som inte är tomt och anropar en annan funktion för varje del av listan. De beskrev hur maskinen hade byggts, provats och lagats då och då.",
}
#: Scripts that only few languages use, and their usual language; at least so many letters of it.
SCRIPTS = {"ru": "Cyrillic", "ar": "Arabic", "ko": "Hangul", "el": "Greek", "he": "Hebrew", "hi": "Devanagari", "th": "Thai"}
LEAST_LETTERS = 8

_QUOTED = regex.compile(r"“[^”]*”|\"[^\"]*\"|`[^`]*`|「[^」]*」|《[^》]*》|[A-Za-z_]+_[A-Za-z_0-9]+(?:\([^)]*\))?")
_WORD = regex.compile(r"\p{Latin}+")
_SMALL = regex.compile(r"(?<![\p{L}\p{N}])\p{Ll}[\p{Ll}']*")
_HAN, _KANA, _OTHER = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"[\p{Latin}\p{Han}\P{L}]")
_IN = {name: regex.compile(rf"\p{{{script}}}") for name, script in SCRIPTS.items()}
_BEGIN = regex.compile(r"(?:^|[.!?¿¡:]\s*)\P{L}*(\p{Lu}\p{Ll}*)")


def words_of(text: str) -> list[str]:
    """Words in lower case: those that begin in lower case, and those that begin a sentence. Names are left out; in a text without lower case all words are kept."""
    if not any(c.islower() for c in text):
        return [w.lower() for w in _WORD.findall(text)]
    first = {m.start(1) for m in _BEGIN.finditer(text)}
    return [w.lower() for m in _WORD.finditer(text) for w in (m.group(),) if w[0].islower() or m.start() in first]


@lru_cache(maxsize=1 << 16)
def grams(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + 3] for i in range(len(padded) - 2))


class Scorer:
    """Log-likelihoods of words by language."""

    def __init__(self, texts: dict[str, list[str]], smooth: float = 0.3):
        self.names = sorted(texts)
        counts = {k: Counter(g for t in texts[k] for w in words_of(t) for g in grams(w)) for k in self.names}
        known = set().union(*counts.values())
        sums = np.array([sum(counts[k].values()) + smooth * len(known) for k in self.names])
        self.none = np.zeros(len(self.names))
        self.table = {g: np.log((np.array([counts[k][g] for k in self.names]) + smooth) / sums * len(known)) for g in known}

    def word(self, word: str) -> np.ndarray:
        return sum((self.table.get(g, self.none) for g in grams(word)), self.none)

    def scores(self, words: list[str]) -> np.ndarray:
        return sum((self.word(w) for w in words), self.none)


def _sentences(text: str) -> list[str]:
    return regex.split(r"(?<=[.?!])\s+", text)


@lru_cache(maxsize=1)
def scorer() -> tuple[Scorer, dict[int, float]]:
    """The scorer, and by number of words the least margin of the best language over the next.

    The margin is the widest by which any piece of that many words of a sentence that the
    scorer hadn't seen was given a wrong language.
    """
    split = {k: _sentences(t) for k, t in TEXTS.items()}
    margins = {n: 0.0 for n in range(1, 13)}
    for part in range(5):
        fitted = Scorer({k: [s for i, s in enumerate(own) if i % 5 != part] for k, own in split.items()})
        for at, k in enumerate(fitted.names):
            for s in split[k][part::5]:
                words = words_of(s)
                for n in margins:
                    for i in range(len(words) - n + 1):
                        got = fitted.scores(words[i : i + n])
                        wrong = np.delete(got, at).max() - got[at]
                        margins[n] = max(margins[n], float(wrong))
    # a longer piece never needs a wider margin
    for n in sorted(margins)[-2::-1]:
        margins[n] = max(margins[n], margins[n + 1])
    return Scorer(split), margins


def latin(words: list[str], least: int = 3) -> str | None:
    """The language of words in Latin script, or null where there are too few or the margin is too small. A repeated word counts once."""
    words = list(dict.fromkeys(words))
    if len(words) < least:
        return None
    fitted, margins = scorer()
    got = fitted.scores(words)
    order = np.argsort(-got)
    margin = got[order[0]] - got[order[1]]
    return fitted.names[order[0]] if margin > margins[min(len(words), max(margins))] else None


@lru_cache(maxsize=1 << 14)
def language(text: str | None, least: int = 3) -> str | None:
    """The language of a sentence, or null if it is too short or unclear to tell; quotations and code aside.

    By script first: names in another script within a sentence don't decide it.
    """
    plain = _QUOTED.sub(" ", text or "")
    han, kana = len(_HAN.findall(plain)), len(_KANA.findall(plain))
    small = sum(len(w) for w in _SMALL.findall(plain))
    if kana >= 3 and 3 * (han + kana) > small:
        return "ja"
    if han >= 5 and 3 * han > small:
        return "zh"
    rest = _OTHER.sub("", plain)
    if len(rest) >= LEAST_LETTERS:
        for name, found in _IN.items():
            n = len(found.findall(rest))
            if n >= LEAST_LETTERS and n > small:
                return name
    return latin(words_of(plain), least)


@lru_cache(maxsize=1 << 14)
def other_than(text: str | None, name: str) -> bool:
    """Whether a text is clearly not in the named language: in another one, in another script, or in Latin script and less likely by more than the margin."""
    own = language(text, 1)
    if own is not None:
        return own != name
    words = list(dict.fromkeys(words_of(_QUOTED.sub(" ", text or ""))))
    fitted, margins = scorer()
    if not words:
        return False
    if name not in fitted.names:
        return len(words) >= 3 and not _HAN.search(text or "")
    got = fitted.scores(words)
    return bool(got.max() - got[fitted.names.index(name)] > margins[min(len(words), max(margins))])
