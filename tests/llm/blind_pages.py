"""Pages for measuring the page body classifier: written from general knowledge of the web, apart from the tables and the
labelled table of the operator. Each line is marked + (main body) or - (furniture)."""

PAGES = """
- Skip to main content
- Home
- News
- Guides
- Podcasts
- Log in | Create account
+ How to repot a houseplant
- By Martha Lane
- Last updated: 4 April 2022
- 5 min read
+ Most houseplants ask for a larger pot every second spring, when roots begin to show at the drainage holes and water runs straight through.
+ What you need
+ - a pot two fingers wider than the old one
+ - fresh compost
+ - a handful of gravel
+ Water the plant the day before, turn the pot on its side and ease the root ball out with both hands, loosening the outer roots if they have started to circle the bottom.
- Advertisement
+ Set the plant at the same depth as before and fill in around it, pressing lightly so that no large gaps are left between the roots.
- This website uses cookies to remember your settings, count visitors and personalise the advertising you see. Some of them are necessary for the site to work while others need your consent, which you can give or refuse for each purpose by choosing "Manage preferences".
- Accept all
- Manage preferences
- Martha Lane is a freelance writer who has covered gardens and the people who keep them for several magazines since 2009; she is the author of two books and can be contacted by email or through our contact form.
- Share on Facebook
- Copy link
- You might also like
- Ten plants that survive in a dark hallway
- Leave a comment
- About us | Contact | Privacy policy | Terms of use
- © 2022 Green Windows Ltd. All rights reserved.

- Nous respectons votre vie privée
- Avec votre accord, nos partenaires et nous utilisons des cookies pour stocker et consulter des données personnelles comme votre visite sur ce site. Vous pouvez refuser ou vous opposer aux traitements fondés sur l'intérêt légitime en cliquant sur « Paramétrer » ou dans notre politique de confidentialité.
- Paramétrer
- Tout accepter
- Menu
- Rechercher
- Accueil > Sciences > Astronomie
+ Pourquoi la Lune change de visage
- Par Julien Mercier
- Publié le 18 mars 2019 à 07h30, mis à jour le 20 mars 2019
- Temps de lecture : 4 min
+ La Lune ne produit aucune lumière : elle renvoie celle du Soleil, et nous n'en voyons que la part éclairée qui se tourne vers nous.
+ Un cycle de vingt-neuf jours
+ Entre deux nouvelles lunes s'écoulent un peu plus de vingt-neuf jours, pendant lesquels le croissant grossit jusqu'au disque entier puis diminue de l'autre côté.
- La suite après la publicité
+ On reconnaît le premier quartier à sa forme de D majuscule, du moins dans l'hémisphère nord.
- Lire aussi : Les marées expliquées en dix images
+ Pour aller plus loin, il suffit d'une paire de jumelles et d'un carnet : dessinez chaque soir ce que vous voyez, à la même heure, et comparez vos croquis au bout d'un mois.
- Recevez chaque vendredi notre lettre d'information : le meilleur de l'actualité scientifique, des expériences à faire en famille et des invitations aux conférences. Votre adresse e-mail ne sera jamais cédée à des tiers et vous pourrez vous désinscrire à tout moment grâce au lien présent dans chaque envoi.
- Je m'abonne
- Partager sur Twitter
- Imprimer
- 12 commentaires
- lune_de_miel : Merci pour cet article, mes élèves ont adoré !
- Martin75 : Bonjour, petite remarque : vous écrivez que le premier quartier a la forme d'un D, mais c'est l'inverse quand on observe depuis l'Australie où j'ai vécu trois ans, et il me semble que cela mériterait d'être précisé dans l'article pour les lecteurs qui voyagent.
- Répondre
- À lire également
- Observer Saturne avec une petite lunette
- Comment naissent les étoiles (7)
- Mentions légales | Plan du site | Nous contacter | Gestion des cookies
- © 2019 Ciel et Espaces libres - Tous droits réservés

- Startseite
- Rezepte
- Anmelden
- Warenkorb (0)
+ Roggenbrot aus dem Holzofen
- 12. Januar 2020 | von Petra Vogel
- Drucken
+ Für zwei Laibe braucht man ein Kilogramm Roggenmehl, reifen Sauerteig, Salz und Geduld, denn der Teig ruht über Nacht und geht nur langsam auf.
+ Zutaten
+ - 1 kg Roggenmehl
+ - 300 g Sauerteig
+ - 20 g Salz
+ - 700 ml Wasser
+ Der Ofen ist heiß genug, wenn ein wenig Mehl auf dem Stein nach einer halben Minute braun wird; dann kehrt man die Glut heraus und schiebt die Laibe ein.
- Wir verwenden Cookies, um Inhalte und Anzeigen zu personalisieren und die Zugriffe auf unsere Website zu analysieren. Außerdem geben wir Informationen zu Ihrer Verwendung unserer Website an unsere Partner für Werbung weiter, wenn Sie zustimmen.
- Alle akzeptieren
- Mehr zum Thema
- Sauerteig selbst ansetzen
- 7 Kommentare
- Newsletter abonnieren
- Impressum | Datenschutz | AGB
- © 2020 Brot und Zeit. Alle Rechte vorbehalten.

- Se connecter
- S'inscrire
- Cours
- Exercices corrigés
- Forum
- Vous êtes ici : Accueil > Collège > Histoire > La ville au Moyen Âge
+ La ville au Moyen Âge
- Ajouté le 02/09/2016 par l'équipe pédagogique
+ I. Les habitants
+ La ville médiévale attire les paysans des environs, qui y trouvent du travail, une protection et, au bout d'un an et un jour, la liberté.
+ 1. Les artisans
+ Ils sont groupés par métier dans des rues qui en portent encore le nom, et chaque métier a ses règles, son saint et sa caisse de secours.
+ 2. Les marchands
+ Ils vont de foire en foire, prêtent de l'argent et finissent par gouverner la commune à la place du seigneur.
+ Vocabulaire
+ Beffroi : tour qui porte la cloche de la commune.
+ Charte : texte qui fixe les droits des bourgeois.
+ Corporation : ensemble des gens d'un même métier.
- Télécharger la fiche en PDF
- Cours suivant : L'Église au Moyen Âge
- Signaler une erreur
- Ce contenu vous a été utile ? Notez-le : 4,3/5 (118 votes)
- Toute reproduction totale ou partielle du contenu de ce site, par quelque procédé que ce soit, sans l'autorisation expresse de l'éditeur est interdite et constituerait une contrefaçon sanctionnée par les articles du code de la propriété intellectuelle.
- CGU | Confidentialité | Contact

+ Recensement des oiseaux du marais
- Publié le 5 mai 2021
- Aucun commentaire
+ Espèce;Couples;Jeunes
+ Héron cendré;12;31
+ Grèbe huppé;7;15
+ Foulque;44;102
+ Busard;3;6
+ Les comptages ont eu lieu à l'aube, par vent faible, depuis les trois observatoires et la digue nord ; les couples douteux n'ont pas été retenus, ce qui explique l'écart avec l'année précédente.
+ L'abonnement des agriculteurs au réseau d'irrigation, négocié en 2015, a changé le niveau d'eau au printemps, et la publicité faite autour de la réserve attire désormais des visiteurs jusque sur les digues.
- Faire un don
- Devenir bénévole
- Suivez-nous sur Facebook
- Articles récents
- La grue est de retour
- Catégories
- Non classé (3)
- Sorties (18)
- Archives
- mai 2021 (2)
- Fièrement propulsé par un logiciel libre
- Retour en haut de page
""".strip().split("\n\n")


def pages() -> list[tuple[list[str], list[int]]]:
    out = []
    for page in PAGES:
        rows = page.split("\n")
        out.append(([r[2:] for r in rows], [int(r[0] == "-") for r in rows]))
    return out
