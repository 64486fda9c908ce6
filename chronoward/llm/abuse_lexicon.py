"""Lexicons of the abuse score: general word lists of English, German, French and Spanish.

A trailing ``*`` stands for any ending. The lists name kinds of language, not the
wording of any collection of texts; what is particular to a collection is learned
from its labels.
"""

from __future__ import annotations

# Insulting names and properties of persons.
INSULT = """
idiot* moron* imbecil* cretin* loser losers scumbag* scum bastard* bitch* whore* slut* shithead* asshole* arsehole* dickhead*
fuckhead* motherfucker* fucker* wanker* prick pricks twat* cunt* douche* retard* brainless braindead dumbass* jackass* jerk
jerks clown clowns dumb dumber stupid* ugly pathetic spineless coward* liar liars freak freaks weirdo* creep creeps crook*
scoundrel* nitwit* halfwit* dimwit* dunce* buffoon* fathead* numbskull* blockhead* simpleton* lowlife* trash garbage filth*
worthless useless disgusting disgrace repulsive revolting vile sickening degenerate* pervert* psycho* lunatic* fool fools
dummkopf* dumm dumme dummer idioten hirnlos* arschloch* wichser* hurensohn* hure huren schlampe* fotze* miststück*
drecksau* drecksack* abschaum missgeburt* trottel* depp deppen vollidiot* spast* penner* blöd* dreckskerl* versager*
widerlich* ekelhaft* lügner* feigling* schwachkopf* schwein* mistkerl* spinner* lächerlich* nichtsnutz*
abruti* connard* connasse* salaud* salope* crétin* débile* imbécile* ordure* enculé* pute* batard* bâtard* pourriture
racaille* minable* bouffon* gueule menteur* lâche* dégueulasse* répugnant* dégoûtant* crapule* ignoble* sale sales
idiota* imbécil* payaso* gilipollas cabrón cabrones cabron* puta putas zorra* hijoputa* asqueros* escoria maricón* maricon*
subnormal* tarado* pendejo* estúpid* estupid* inútil* mentiros* cobarde* basura repugnante* sinvergüenza* tonto* tonta*
""".split()

# Slurs and names that dehumanise a group or person.
DEHUMANISE = """
vermin maggot* parasite* cockroach* rats rat leech* plague* pest pests disease* infest* infect* swine pigs pig
subhuman* savage* animals animal beasts beast mongrel* barbarian* invader* scum filth* dirt* cancer* sewer* rotten rot
nigger* faggot* fag fags kike* spic spics gook* tranny* raghead* wetback* chink* paki pakis
ungeziefer untermensch* schmarotzer* ratten ratte pest seuche* gesindel pack kakerlake* kanake* abschaum tiere vieh krankheit*
verseuch* brut dreck* parasit*
vermine* cafard* parasites rats peste nuisible* sauvages bêtes animaux crasse maladie* porcs porc bougnoule*
ratas rata plaga* alimañas cucaracha* animales bestias cerdos cerdo peste sudaca* enfermedad* parásito* mugre
""".split()

# Profanity.
PROFANE = """
fuck* shit shits shitty bullshit piss pissed damn* crap crappy arse ass bollocks bloody goddamn* wtf stfu
scheiss* scheiß* ficken fick verpiss* verdammt* kacke mist merde* foutre chier putain bordel joder coño carajo hostia mierda*
""".split()

# Explicit sexual words.
SEXUAL = """
sex sexy sexually porn* xxx nude* naked pussy pussies cock cocks dick dicks tits titties boobs penis vagina* cum cumming
orgasm* blowjob* handjob* masturbat* erotic* horny anal milf* hooker* hookers moan* stripped stripper* undress* panties
lingerie genital* erection* slutty fetish* escort escorts seduc* thrust* nipple* breasts buttocks
schwanz schwänze titten muschi* nackt* geil* wichs* bumsen blasen möse brüste höschen
bite bites queue chatte* seins nichons nue nues nus baise* branl* bander masturb* nichon* culotte* cul
polla pollas tetas desnud* follar folla follan culo coño verga vergas pajea* paja chupa* mamada* masturb* pechos
""".split()

# Violence against persons.
VIOLENCE = """
kill kills killed killing bleed* blood beat beaten stab* strangl* slap* punch* rape raped murder* slit hang hanged shoot
shot burn burned burning smash* crush* break breaks broken hurt hurts suffer* torture* drown* slaughter* butcher* choke*
die dies dying dead death cripple* knife knives gun bullet* throat* skull* bones whip* lynch* bury buried grave corpse*
umbringen töten tötet verreck* abstech* erschlag* schlagen prügel* knüppel* verprügel* stirb sterben brennen verbrenn*
erwürg* aufhäng* erschieß* blut messer kehle leiche* grab knochen fresse
tuer tuez tué tuerai crever crève* égorg* frapp* casser brûl* mourir meurs mort pendre pendu saigner sang couteau* étrangl*
violer tombe
matar matan mueras muérete morir muera apuñal* golpe* quemar quemen sangre cuchillo* ahorcar estrangul* violar romper
paliza* tumba muerto muerta
""".split()

# Expulsion and exclusion.
EXPEL = """
out away deport* expel* banish* exterminat* eradicat* wipe wiped cleanse* clean gas gassed purge* throw thrown drive driven
kick kicked remove removed rid ban banned locked cage caged fence chased segregat* unwanted infested allowed
raus hinaus vertreib* vertrieben abschieb* ausrott* vernicht* vergas* säuber* verbannt* rauswerf* weg eingesperrt fort
dehors chass* expuls* extermin* éliminer nettoy* virer renvoy* enfermer interdi*
fuera echar* expuls* extermin* elimin* limpiar deport* largo encerr* prohib*
""".split()

# Groups of people.
GROUP = """
people folk immigrant* migrant* refugee* foreigner* newcomer* outsider* muslim* jew jews jewish christian* hindu* gypsies
gypsy roma arab arabs african* asian* black blacks white whites latino* mexican* women woman gays gay lesbian* queer*
trans transgender race races tribe* breed kind believers minorit* natives peasants disabled cripples poor homeless
ausländer* flüchtling* migranten zuwanderer* juden jude jüdisch* muslime muslim* moslem* zigeuner* frauen schwule* lesben
schwarze* leute volk rasse behinderte* fremde*
étranger* immigré* migrants réfugié* juif* juive* musulman* arabe* noirs gitans femmes gays homosexuel* gens race peuple
extranjer* inmigrante* refugiad* judío* judía* musulman* moros gitanos negros mujeres gays homosexual* gente raza pueblo
""".split()

# Contempt, ill wishes and worthlessness.
CONTEMPT = """
nobody nothing ashamed shame shameful deserve* hate hated hates despise* loathe* regret* miss missed hope wish stink*
smell* stench brain brains shut crawl rock mother mothers mouth face pity laugh* joke waste wasted wasting pathetic sick
disgust* vomit* puke barf spit worst ruin* failure unwanted unloved lonely cry crying begging grovel* beneath inferior
niemand nichts schäm* scham verdien* hass* verachte* vermiss* bereu* stinkt stinken gehirn hirn klappe maul mutter
schande wertlos* ekel* spuck* kotz* peinlich*
personne rien honte mérite* déteste* hais méprise* regrett* puer pue cerveau ferme taisez mère cracher vomir inférieur*
pleur* nul nulle
nadie nada vergüenza merece* odio odia* desprecio* lamentar* apesta* cerebro calla* cállate madre boca cara escupir vomit*
inferior* llorar lástima asco
""".split()

# Menace (places, times and warnings).
MENACE = """
find found know knows live lives sleep* home house door tonight tomorrow coming watch watching wait waiting careful warn*
soon family children address street follow* behind window night back sorry promise* pay next careful fire beg hide
finden wissen wohnst wohnt schläft haus tür heute morgen warte* warnung bald familie kinder adresse nacht holen versprech*
pass büßen bezahl* feuer versteck*
trouver retrouv* savons sais habite* dors maison porte soir demain attend* prévenu bientôt famille enfants adresse nuit
promets paier* cache*
encontrar* sabemos vives vive duermes casa puerta noche mañana esperando cuidado pronto familia hijos dirección prometo
pagar* fuego esconde*
""".split()

# Solicitation and advertising of sexual content.
LURE = """
click video videos pics picture pictures photos webcam cam cams free hot girls girl wives wife adult adults singles call
chat uncensored leaked dirty hardcore watch bed room pants looking wild wet huge big hard tongue lips
klick bilder heiße heiss kostenlos mädchen frauen ruf schmutzig* privat
clique vidéo vidéos photos gratuit* chaude* filles appelle* cochon* lit
clic vídeo vídeos fotos gratis caliente* chicas llama sucia* cama
""".split()

# Words that address the reader or an author.
SECOND = """
you your you're youre yours u ur yourself yourselves author editor editors admin admins whoever
du dich dir dein deine deinem deinen deiner ihr euch euer
tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros eres
""".split()

# The speaker.
FIRST = """
i i'm im me my we we're us our ich mich mir mein meine wir uns je j'ai moi mon ma nous notre on yo mi nosotros
""".split()

# Other persons spoken of.
THIRD = """
he him his she her they them their theirs this that those these er ihn ihm sie ihnen diese dieser lui leur eux elle elles
ils ces cette él ella ellos ellas les estos esos esas
""".split()

# Demands and generalisations.
MODAL = """
should must ought deserve* all every each never none only always anyone everyone no not need needs let
sollte* muss müssen alle jeder jede nie niemals keiner kein keine immer nur gehör* darf
doit doivent devrait devraient tous toutes jamais aucun aucune toujours seul faut
debe deben debería* todos todas nunca ningún ninguna siempre solo hay
""".split()

# Registers in which strong words are used neutrally (medicine, law, biology, arts, history, technology).
REGISTER = """
clinic* patient* medical medicine surger* symptom* diagnos* therap* treatment* syndrome* tumour* tumor* virus* bacteri*
anatom* infection* epidemic* disorder* physician* hospital* transmi* reproduct* hormone*
court* convict* statute* defendant* prosecut* sentenced jur* legislat* offence* police* crime* criminal* law laws
species genus subspecies habitat* breeding plumage larva* mammal* botan* zoolog* taxonom* wildlife veterinar*
novel novels opera* film films paint* sculpt* museum* gallery exhibit* poem* poet* theatre album* literary literature
character* playwright heraldr* portray* depict* fresco* scene scenes
battle* treaty army armies soldier* war siege* historian* archaeolog*
software process* server* kernel* function* protocol* linguist* etymolog* surname* derive* phrase* pronounc*
klinik* krankenhaus* behandlung* erkrankung* gericht* gesetz* verurteil* gattung* vogel* gemälde* roman schlacht* krieg*
clinique* hôpita* traitement* tribunal* loi condamn* espèce* oiseau* tableau* roman bataille* guerre*
clínica* tratamiento* tribunal* ley especie* especies ave cuadro* novela* batalla* guerra*
""".split()

CATEGORIES = {
    "insult": INSULT, "dehumanise": DEHUMANISE, "profane": PROFANE, "sexual": SEXUAL, "violence": VIOLENCE, "expel": EXPEL,
    "group": GROUP, "contempt": CONTEMPT, "menace": MENACE, "lure": LURE, "second": SECOND, "first": FIRST, "third": THIRD,
    "modal": MODAL, "register": REGISTER,
}

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ɡ": "g", "ı": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "η": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "І": "I", "Ѕ": "S", "Ј": "J", "У": "Y", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
}
# Digits and signs used for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"}
