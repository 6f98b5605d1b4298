"""Language of prose, told from profiles of character runs.

The profiles are counted here from public texts, the first articles of the Universal
Declaration of Human Rights, and from common function words. A word's likelihood under
each language is the mean over its character runs; scripts that only one of the
languages uses decide at once.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

# fixed values: public text in each language told apart
TEXTS = {
    "en": "all human beings are born free and equal in dignity and rights. they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. everyone is entitled to all the rights and freedoms set forth in this declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status. everyone has the right to life, liberty and security of person. no one shall be held in slavery or servitude. no one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. everyone has the right to recognition everywhere as a person before the law. all are equal before the law and are entitled without any discrimination to equal protection of the law",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren. sie sind mit vernunft und gewissen begabt und sollen einander im geiste der brüderlichkeit begegnen. jeder hat anspruch auf alle in dieser erklärung verkündeten rechte und freiheiten, ohne irgendeinen unterschied, etwa nach rasse, hautfarbe, geschlecht, sprache, religion, politischer oder sonstiger anschauung, nationaler oder sozialer herkunft, vermögen, geburt oder sonstigem stand. jeder hat das recht auf leben, freiheit und sicherheit der person. niemand darf in sklaverei oder leibeigenschaft gehalten werden. niemand darf der folter oder grausamer, unmenschlicher oder erniedrigender behandlung oder strafe unterworfen werden. jeder hat das recht, überall als rechtsfähig anerkannt zu werden. alle menschen sind vor dem gesetz gleich und haben ohne unterschied anspruch auf gleichen schutz durch das gesetz",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits. ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. nul ne sera tenu en esclavage ni en servitude. nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique. tous sont égaux devant la loi et ont droit sans distinction à une égale protection de la loi",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. toda persona tiene todos los derechos y libertades proclamados en esta declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición. todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. nadie estará sometido a esclavitud ni a servidumbre. nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica. todos son iguales ante la ley y tienen, sin distinción, derecho a igual protección de la ley",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. ad ogni individuo spettano tutti i diritti e tutte le libertà enunciate nella presente dichiarazione, senza distinzione alcuna, per ragioni di razza, di colore, di sesso, di lingua, di religione, di opinione politica o di altro genere, di origine nazionale o sociale, di ricchezza, di nascita o di altra condizione. ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. nessun individuo potrà essere tenuto in stato di schiavitù o di servitù. tutti sono eguali dinanzi alla legge e hanno diritto, senza alcuna discriminazione, ad una eguale tutela da parte della legge",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos. dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. todos os seres humanos podem invocar os direitos e as liberdades proclamados na presente declaração, sem distinção alguma, nomeadamente de raça, de cor, de sexo, de língua, de religião, de opinião política ou outra, de origem nacional ou social, de fortuna, de nascimento ou de qualquer outra situação. todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. ninguém será mantido em escravatura ou em servidão. todos são iguais perante a lei e, sem distinção, têm direito a igual protecção da lei",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren. zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. een ieder heeft aanspraak op alle rechten en vrijheden, in deze verklaring opgesomd, zonder enig onderscheid van welke aard ook, zoals ras, kleur, geslacht, taal, godsdienst, politieke of andere overtuiging, nationale of maatschappelijke afkomst, eigendom, geboorte of andere status. een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. niemand zal in slavernij of horigheid gehouden worden. allen zijn gelijk voor de wet en hebben zonder onderscheid aanspraak op gelijke bescherming door de wet",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах. они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей декларацией, без какого бы то ни было различия, как то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения. каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. никто не должен содержаться в рабстве или в подневольном состоянии. все люди равны перед законом и имеют право, без всякого различия, на равную защиту закона",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах. вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. кожна людина повинна мати всі права і всі свободи, проголошені цією декларацією, незалежно від раси, кольору шкіри, статі, мови, релігії, політичних або інших переконань, національного чи соціального походження, майнового, станового або іншого становища. кожна людина має право на життя, на свободу і на особисту недоторканність. ніхто не повинен бути в рабстві або у підневільному стані. всі люди рівні перед законом і мають право, без будь-якої різниці, на рівний їх захист законом",
}
# fixed values: the commonest function words of these languages
COMMON = {
    "en": "the of and to in a is that it for on with as was be by at or an are this not but from have which you when if can how what where why does do will would should could there their its than then into only also each more your we they has had who since about after before inside during while under over until because between through into against once any all both some may must cannot whether without within upon yes no here these those such",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kann wenn was wer wo warum welche ich wir ohne damit seit vor während unter zwischen gegen bevor danach weil ob jede jeder alle dieser diese dieses muss soll darf ja nein hier",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y elle avec cette ces être peut sans nous vous quand comment pourquoi où quelle quel avant après je on lorsque aussi depuis pendant sous entre contre jusque parce chaque tous toutes doit oui non ici ces ses aux cet",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy qué cómo dónde por qué cuál puede puedo hay tiene antes después cada desde durante bajo hasta porque todos todas debe sí aquí estos estas sus cual mientras contra",
    "it": "di che e la il un a per in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo qui del della dei nel alla più quando dove perché quale può essere viene gli anche senza prima dopo ogni",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre depois sem onde porque qual pode cada",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar naar heb hoe heeft hebben deze want nog zal wie waarom waar kan wordt",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой что весь год от так о для ты же все тот мочь вы такой его только или ещё бы себя один как уже до время если когда где почему какой можно нужно при чтобы нет",
    "uk": "і в не на я бути він з що а по це вона цей до але вони ми весь який із у то за свій від так про для ти же всі той могти ви такий його тільки або ще б себе один як вже час якщо коли де чому можна треба при щоб немає та",
}
LANGUAGES = tuple(TEXTS)
#: Runs of this many characters at most; weight of the function words; smoothing.
LONGEST, REPEATS, PRIOR = 4, 5, 0.5
_SCRIPTS = (("zh", re.compile("[一-鿿]")), ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")))
_CAMEL = re.compile(r"[a-z][A-Z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _runs(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " "]


class Languages:
    """Evidence for each language in a text's words; the profiles are counted when it is made."""

    def __init__(self, texts: dict[str, str] = TEXTS, common: dict[str, str] = COMMON, limit: int = 200_000) -> None:
        self.names = tuple(texts)
        counts = [Counter() for _ in texts]
        for c, name in zip(counts, texts):
            for w in _WORD.findall(texts[name].lower()) + _WORD.findall(common.get(name, "").lower()) * REPEATS:
                c.update(_runs(w))
        known = sorted(set().union(*counts))
        table = np.array([[c[r] for c in counts] for r in known], np.float64) + PRIOR
        self._log = dict(zip(known, np.log(table / table.sum(axis=0))))
        self._other = np.log(PRIOR / np.array([sum(c.values()) + PRIOR * len(known) for c in counts]))
        self._words: dict[str, np.ndarray] = {}
        self._limit = limit

    def _word(self, word: str) -> np.ndarray:
        w = word.lower()
        rs = _runs(w)
        v = sum((self._log.get(r, self._other) for r in rs), np.zeros(len(self.names))) / len(rs) * min(len(w) + 1, 6)
        if len(self._words) > self._limit:
            self._words.clear()
        # a name in mixed case is no word of any language
        self._words[word] = np.zeros(len(v)) if _CAMEL.search(word) else v - v.mean()
        return self._words[word]

    def evidence(self, words: list[str]) -> np.ndarray | str | None:
        """Log-likelihoods of the languages, a language that the script alone gives, or null without a word."""
        if not words:
            return None
        text = "".join(words)
        if not text.isascii():
            for name, script in _SCRIPTS:
                if (hits := len(script.findall(text))) * 3 > len(text):
                    return "ja" if name == "zh" and len(_SCRIPTS[1][1].findall(text)) * 10 > hits else name
        known = self._words
        return np.array([known[w] if w in known else self._word(w) for w in words]).sum(axis=0)

    def best(self, text: str) -> str | None:
        """The likeliest language of a text; null where nothing tells."""
        e = self.evidence(_WORD.findall(text))
        return e if e is None or isinstance(e, str) else self.names[int(np.argmax(e))]
