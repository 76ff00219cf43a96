"""The labelled table of the boilerplate classifier: invented pages, each line marked + (main body) or - (furniture).

It has under 420 lines and is the only thing the trees are trained on.
"""

PAGES = """
- Accueil | Recettes | Techniques | Contact
- Connexion
- Vous êtes ici : Accueil > Potager > Tomates
+ Bien planter ses tomates au printemps
- Publié le 4 mai 2021 par L. Garnier
+ Les tomates demandent une terre profonde et bien drainée, que l'on prépare dès la fin de l'hiver avec un peu de compost mûr. Les plants sont mis en place après les gelées.
+ Arroser sans excès
+ Un arrosage régulier au pied, le matin, évite les maladies du feuillage et l'éclatement des fruits pendant les étés très chauds.
- Publicité
- Mis en ligne le mardi 6 mai 2021 à 9h30 par la rédaction
- ACCUEIL – SEMIS – RÉCOLTES – PLAN DU SITE – CONTACT
+ On supprime ensuite les petites pousses qui naissent à l'aisselle des feuilles, puis on attache la tige à son tuteur à mesure qu'elle grandit.
- À lire également
- → Tailler la vigne en février
- Les semis de mars (12)
- 34 commentaires
- Partager cet article
- © 2021 Le Potager – Tous droits réservés
- Mentions légales | Plan du site | Confidentialité

- Ce site utilise des cookies pour mesurer son audience. En continuant, vous acceptez leur usage.
- J'accepte
- Personnaliser
- Menu
- Physique
- Chimie
- Histoire
- Archives (12)
- Nouveautés (88)
+ La chute des corps selon Galilée
+ Deux corps lâchés ensemble touchent le sol au même moment, si l'air ne les freine pas : voilà ce que montre l'expérience de la tour, que l'on raconte encore aux élèves.
+ Matériel nécessaire :
+ - une bille de plomb ;
+ - une bille de bois ;
+ - un chronomètre ;
+ - deux mètres de fil.
+ On mesure ensuite dix fois la durée de la chute et l'on retient la moyenne, en notant à part les essais manqués.
- La suite après cette publicité
- Publié le dimanche 7 octobre 2012 par H. Lambert, pour Le Cahier
+ Les écarts viennent surtout du départ, que la main ne donne jamais au même instant pour les deux billes.
- Voir aussi : Le pendule de Foucault
- Vu 233 fois
- Inscrivez-vous à notre lettre d'information et recevez nos cours chaque mardi.
- Votre adresse e-mail
- Retour en haut

- Fermer le menu
- Se connecter / S'inscrire
- Accueil » Histoire » Les ponts de pierre
+ 3. Les ponts de pierre
- 12 mars 2018 | P. Rolland, pour Le Passé
+ Quelle fut la première arche ? Nul ne le sait, mais les maçons de la vallée en bâtissaient déjà au douzième siècle, d'après les comptes de l'abbaye qui nous sont parvenus.
+ « Le pont tiendra cent ans », disait-on alors.
- Voir aussi : Comprendre les lavoirs de la vallée haute et leurs usages au siècle dernier
+ Le péage
+ Chaque charrette payait deux deniers, et les piétons passaient sans rien donner, sauf les jours de foire où la règle changeait.
- → Les bacs de la rivière (8)
- » Les moulins à vent
- - Les gués du canton de Saverne
- - Pourquoi étudier les péages de Lens
- Arras (1640) – siège et canaux
- - Les quais de la ville basse
- Les moulins à eau – lire la suite...
- - Les chemins de halage (3)
- ← Page précédente : Les lavoirs du canton
- Imprimer
- Signaler une erreur
- Les contenus de ce site sont fournis à titre indicatif et n'engagent pas la rédaction.

- Lettres
- Sciences
- Loisirs utiles
- Voyages
- Textes / Images / Sons
- Enfants · Parents · Écoles · Clubs
- Sign in or register
- Home | Lessons | Archive | About us
- Posted on 2014-03-09 by J. Miller
+ Reading a weather map
+ A weather map joins the places of equal pressure by thin lines, and where the lines crowd together the wind is strong. Beginners should first look for the highs and the lows.
+ Fronts are drawn as thick lines with small teeth, and the teeth point to the side that the air is moving to.
- Advertisement
- You may also like
- How clouds form (4)
- » A short history of the barometer
- Share this page
- Subscribe to our newsletter
- 16 comments
- maria87: Thanks, very clear!
- old_sailor: I had forgotten the teeth, thank you.
- © 2014 The Weather Room. All rights reserved.
- Back to top

- Diese Website verwendet Cookies.
- Alle akzeptieren
- Anmelden oder registrieren
- Startseite | Themen | Archiv | Kontakt
+ Der Bau einer Sonnenuhr
- Von K. Brandt, 12.04.2016
+ Der Schattenstab muss genau nach Norden zeigen und so steil stehen, wie es die geographische Breite des Ortes verlangt; sonst geht die Uhr im Winter falsch.
+ Die Stundenlinien
+ Für jede Stunde dreht sich die Sonne um fünfzehn Grad, doch auf der Platte liegen die Linien ungleich weit auseinander, weil sie schräg getroffen wird.
- Das könnte Sie auch interessieren
- Wasseruhren im Altertum
- Beitrag teilen
- Impressum | Datenschutz
- Nach oben

- Le portail des jeunes lecteurs
- Abonnez-vous
+ Horaires des visites de septembre
+ 9h30 : atelier Duval, gravure
+ 10h15 : atelier Morel, reliure
- >> La reliure au XVIIIe siècle
+ 11h00 : atelier Petit, dorure
+ 13h45 : atelier Simon, papier
- Publicité
+ 14h30 : atelier Roux, presse
+ 16h00 : atelier Blanc, encre
- Ajouter à l'agenda
- Mots-clés : atelier, visite, papier, encre
- Suivez-nous sur les réseaux
- Notre partenaire vous offre le premier mois.

- Accueil
- Dossiers
- Agenda
- Nous contacter
+ Relevés de la station du lac
+ Jour;Vent;Pluie;Niveau
+ lundi;12,5;0,0;31
+ mardi;14,0;2,5;32
+ mercredi;9,5;11,0;35
+ jeudi;n.d.;4,0;36
+ vendredi;8,0;0,5;35
- Réf. 2017-33
- Télécharger en PDF | Imprimer | Envoyer à un ami
- Consulté 45 fois depuis le 3 mars 2017

- Identifiez-vous
- Lycée
- Collège
+ Comprendre les conditions de vente : le cas de Saverne
+ L'annonce d'un prix engage le marchand, dit le règlement, et le contrat n'est formé que si l'acheteur l'accepte dans le délai prévu par les deux parties.
+ La mention légale au dos du billet
+ Elle rappelle les droits du voyageur, le nom du transporteur et le moyen de réclamer, sans quoi la compagnie reste tenue du dommage.
+ Recette de cookies de l'école
+ On mélange le beurre et le sucre, puis la farine, et l'on forme de petites boules que l'on cuit douze minutes dans un four bien chaud.
- À découvrir : Le carnet de comptes d'un meunier
- L'auteur : J. Vidal enseigne le droit et collabore à cette revue depuis dix ans.
- Cet article fait partie du dossier « Commerce et loi » proposé par la rédaction.
- J'aime 12
- Citer
- Site réalisé par l'atelier Dubreuil, version 4

- ACCUEIL – GUIDES – PLAN DU SITE
- ACCUEIL – COURS – ARCHIVES – CONTACT
- Le bulletin / Les cahiers / Les cartes
- Enfance
- Jeunesse
- Métiers
- Rechercher
- Toutes les rubriques
- La suite de la page après la publicité
+ Q : Combien d'arbres faut-il pour une haie de trente mètres si l'on plante tous les deux mètres et que l'on commence au bord ?
+ R : Seize, car il en faut un de plus que d'intervalles.
- Écrit par C. Arnaud | 7 septembre 2020 | Temps de lecture : 84 min
+ Autre méthode
+ On peut aussi dessiner la haie et compter les troncs, ce qui évite l'erreur la plus courante chez les jeunes élèves.
- 3 réponses à « Planter une haie »
- lucie_44 : Merci pour la solution, mon fils a compris.
- jeanne88 : Quelqu'un a-t-il la correction de l'exercice ? À Tours aussi.
- marcel61 : Moi, chez nous, on comptait les trous et non les arbres, enfin bon.
- odile07 : Une coquille au deuxième paragraphe, me semble-t-il.
- paul12 : Bonjour, et pour une haie ronde ?
- Vous devez être membre pour répondre.
- Nos autres cours
- Les fractions – lire la suite...
- → Les pourcentages

+ L'onde et la lumière
+ La lumière se propage en ligne droite tant que le milieu reste le même, et c'est pourquoi les ombres ont des bords nets près de l'objet qui les
+ porte. Plus loin, la pénombre les entoure d'un gris léger,
+ que l'on voit bien au coucher du soleil,
+ quand les arbres s'allongent sur la route.
+ Expérience simple
+ Une lampe, un carton percé et un écran suffisent
+ pour montrer le chemin des rayons dans la pièce.
- Contenu sponsorisé
- Articles récents
- Le son dans l'eau
- 7 partages

- Boutique
- Passer au contenu
- Nos engagements de confidentialité ont changé : choisissez vos préférences.
- Tout refuser
+ LE MARCHÉ AUX GRAINS DE LA VILLE HAUTE
+ LE BLÉ ARRIVAIT PAR LA RIVIÈRE ET SE VENDAIT SOUS LA HALLE, OÙ LES MESUREURS JURÉS VEILLAIENT À LA JUSTESSE DES POIDS ET DES BOISSEAUX.
+ leçon deux le seigle et l'orge se vendaient le samedi sur la petite place et les meuniers venaient de loin pour les acheter avant midi
- COPYRIGHT 2012 LES AMIS DE LA HALLE
- PLAN DU SITE – CONTACT – ACCESSIBILITÉ : PARTIELLE
- Faire un don à l'association
- Recevoir les alertes des Amis de la Halle
- En ce moment sur le site
- Reproduction interdite sans l'accord de l'association.

- Identifiant oublié ?
- Copier le lien
- Noter cet article : 4/5
- Écrit par M. Leroy | dimanche 2 juin 2019 | Temps de lecture : 6 min
- Revue du soir > Cuisine > Le pain noir
+ Le pain noir
+ 1. Farine de seigle (500 g)
+ 2. Levain frais (200 g)
+ 3. Sel gris (10 g)
+ 4. Eau tiède (350 g)
+ Pétrir dix minutes, laisser lever une nuit entière dans un linge, puis cuire à four vif pendant trois quarts d'heure sans ouvrir la porte.
- Sur le même sujet :
- Le pain blanc (33)
- - La brioche
- Mis à jour le 7 juin 2019 à 10h12
- Commentaires fermés
- Découvrez aussi nos ateliers du samedi
- Page suivante : Le levain

- Par M. Sorel, le 3/4/2015
+ Brest (1694) – rade et canons
- Inscrivez-vous à notre lettre et recevez chaque mois le récit d'une bataille navale.
+ La flotte attendait le vent dans la rade, et les canonniers comptaient la poudre à la lueur des lanternes en chantant à voix basse.
- Sources / Cartes / Récits
- Brest (1694) – rade et canons (4)

- Cours
- Exercices
- Annales
- Connexion
+ Hameaux de la vallée
+ Beaulieu
+ Pierrefitte
+ Rochefort
+ Villeneuve
- Publicité
+ Aubeterre
+ Bellegarde
+ Castelnau
+ Fontenay
+ Sauveterre
- Voir aussi
- Les foires de la vallée (9)
- Conditions d'utilisation

- Fiches
- Corrigés
+ Élèves de la promotion
+ Aubry
+ Bertin
+ Carlier
+ Fournier
+ Germain
+ Humbert
- La suite après la publicité
- 12 partages

- Connexion
+ Relevés du port
+ Quai,Tirant,Longueur
+ Nord,4.5,120
+ Sud,n.d.,95
+ Est,6.1,140
+ Ouest,3.9,88
- Réf. 44-10
+ - 12 kg de sel gris
+ - 3 sacs de farine
+ - 40 m de corde fine
+ - 2 l d'huile de lin
- → Les phares de la côte

- Inicio | Cursos | Contacto
- Iniciar sesión
+ El ciclo del agua
+ El agua se evapora del mar, forma las nubes y vuelve a la tierra en la lluvia; los ríos la llevan otra vez al mar, y así empieza todo de nuevo.
- Publicado el 3 de mayo de 2015 por R. Soto
- Suscríbete al boletín
- © 2015 Aula Abierta. Todos los derechos reservados.
- Leer más

- Primaire | Secondaire | Supérieur
- La lettre du musée
- Le journal / La boutique / Les expositions
- 210 partages
+ Les collections du rez-de-chaussée
+ | Salle | Objets | Surface |
+ | Bronzes | 120 | 85,5 |
+ | Monnaies | 2310 | 40,0 |
+ | Verres | n.d. | 61,2 |
+ | Ivoires | 95 | 33,7 |
- — Annonce —
+ | Armes | 410 | 90,1 |
+ | Horloges | 75 | 28,4 |
- Sponsorisé par nos partenaires
- Conditions générales d'utilisation
- J'ai lu et compris
- Bronzes et ivoires du musée de Lens – lire la suite...

- Actualités
- Vidéos
- Quiz
+ Pourquoi étudier le témoin d'une expérience
+ Le témoin est le tube auquel on n'ajoute rien : sans lui, on ne saurait pas si le changement vient du produit ou du temps qui passe.
+ 62 élèves sur 80 l'oublient la première fois.
+ Vers 1900, près de Dijon, un chimiste en fit une règle, et son carnet montre déjà deux colonnes pour chaque essai, l'une pour le témoin.
+ Leçon 7 : le tube et le ballon
+ Le ballon supporte la flamme mieux que le tube, car son verre est plus mince et sa forme répartit la chaleur sur toute la paroi.
+ On le remplit au tiers.
- Lire aussi : Leçon 9 : la pesée sans balance au laboratoire du lycée
+ Le bouchon ne doit jamais être serré pendant le chauffage, sinon la vapeur le projette à travers la salle.
+ Selon Mme Perrin, la moitié des accidents de l'année sont venus de là.
- Autres articles
- Les cristaux de sel de Guérande
- » Le papier filtre (7)
- Peser sans balance (12)
- À propos de l'auteur : C. Perrin collabore à plusieurs revues et prépare un livre de fiches.
- Les alertes du laboratoire

- À la une
- Les plus lus
- - Le code de l'ancien port (41)
- Calcul et mémoire : l'exemple de Turing
- → La table et l'index – lire la suite...
+ Calcul et mémoire : l'exemple de Turing
- Par Antoine Weber, le 14 juin 2012
- Par Antoine Weber
+ Une machine lit une case, écrit un signe, puis avance ou recule : rien de plus ne lui est permis, et cela suffit pour tout calcul connu.
- À découvrir : Pourquoi étudier la table de calcul de Babbage en classe de seconde
+ La bande
+ Elle n'a pas de fin, du moins sur le papier, et chaque case porte un signe ou reste vide jusqu'à ce que la tête passe dessus.
- Retrouvez l'intégralité du dossier « machines » dans notre bibliothèque.
- Nos autres dossiers
- L'algorithme de l'abaque
- Mise à jour : 12/07/2012
- Page 2 »

- Skip to content
- Log in
- Popular articles
- The old mill of Barton (3)
+ The honey harvest
- Read also: Understanding the queen, her court and the drones of the hive
+ The first combs are cut in June, when the lime trees have flowered, and the last ones early in September before the nights turn cold.
+ Tools of the trade
+ A knife kept warm in water, a sieve and a row of clean jars are all that a small keeper needs on the day.
- Accept all
- We use cookies to improve your visit.
- By Tom Shaw
- Written by T. Shaw, a freelance journalist with a garden of his own.
- Read more
- Bees in winter
- Reply
- 4 replies to "The honey harvest"
- tom_b: Does it work with clover?

+ Inventaire de la remise
+ Clous : 12 boîtes
+ Cordes : 4 rouleaux
+ Planches : 31 pièces
+ Scies : 2 grandes
+ Pinceaux : 9 fins
- Ajouter un commentaire
- Reproduction soumise à l'accord écrit de l'éditeur.
- Hébergement assuré par la commune.
- Gérer mes préférences de suivi
- Mot de passe perdu
- S'abonner à partir de 5 euros par mois, sans engagement

- Von B. Klee, 2018-03-04
+ Notizen aus dem Garten
+ Im März werden die Beete umgegraben und die ersten Erbsen gelegt, sobald der Boden nicht mehr an der Schaufel klebt und die Nächte milder sind.
+ Lektion 4: Das Gießen
+ Am besten gießt man am frühen Morgen, weil das Wasser dann langsam einsickert und die Blätter bis zum Abend wieder trocken werden.
- Mehr zum Thema
- Der Kompost (5)
- 12 Kommentare
- Newsletter abonnieren
- © 2018 Gartenbote. Alle Rechte vorbehalten.

- R. Le Goff – mis à jour le 3 mai à 9h12
+ Sel et farine à Guérande
+ Le sel gris se récolte à la main, de juin à septembre, quand le vent d'est a séché les bassins les moins profonds.
- Partagez : courriel, messagerie, imprimer
+ La farine de blé noir vient des champs voisins et se moud encore à la pierre dans deux moulins du bourg.
+ Notes
- → Les foires du canton
+ Le marché se tient le jeudi.
+ Comprendre le consentement et la vie privée des anciens
+ Au bourg, nul n'entrait dans une maison sans frapper, et le registre des visites, tenu par le curé, ne sortait jamais de la sacristie avant sa mort.
+ Pourquoi étudier le cookie et le traceur du chasseur
+ Le traceur suit la bête à l'empreinte, et le biscuit sec que les anciens nommaient cookie lui sert de repas pendant la longue marche.
+ Verdun (1916) – boue et acier
+ Les lettres du front parlent peu des combats et beaucoup du froid, du pain et des camarades, car la censure lisait tout avant l'envoi.
+ La mention légale obligatoire de l'affiche
+ Elle nomme l'imprimeur, disait la loi, et l'oublier coûtait une amende que les petits ateliers ne pouvaient pas payer.
- Classé dans : sel, farine, moulin
- Tags : marché, jeudi
- Le Courrier des marais : le site des curieux
- Très bel article, merci !
- Abonné depuis 2011, je ne reçois plus rien depuis un mois.

- Nous utilisons, avec nos partenaires, des cookies et des technologies similaires pour consulter des informations sur votre appareil, mesurer l'audience du site et vous proposer des contenus adaptés à vos centres d'intérêt. Vous pouvez modifier vos choix en bas de page.
- Accueil | Recettes | Entrées | Plats | Desserts | Boissons | Techniques | Vidéos | Forum | Boutique | Livres | Concours | Partenaires | Qui sommes-nous | Contact
+ Le moulin à café
+ Le moulin à manivelle broie les grains entre deux meules d'acier dont l'écart se règle par une vis ; plus elles sont proches, plus la mouture est fine et plus le café est fort, mais l'eau passe alors lentement et le goût devient amer.
+ Un cookie, ou témoin de connexion, est un petit fichier que le serveur envoie au navigateur et que celui-ci renvoie à chaque visite ; le cookie de session disparaît à la fermeture, tandis que le traceur d'un tiers suit le lecteur d'un site à l'autre pendant des mois.
+ Si le serveur ne reçoit pas le cookie, il croit voir un nouveau lecteur et recommence son calcul ; l'historien du réseau y voit la trace d'un temps où la mémoire d'une machine coûtait cher et où l'on cherchait à tout garder chez l'autre.
+ La loi impose à tout éditeur de demander l'accord du lecteur avant de déposer un cookie sur son ordinateur, et les juges ont précisé que cet accord doit être donné par un acte clair et non par une case déjà cochée.
+ « Écoutez le grain », disait le vieux brûleur à ses apprentis ; et il ajoutait, en fermant la porte du four : « Quand il craque deux fois, vous avez dix secondes, pas une de plus, pour tout verser sur la table. » Chez lui, personne ne s'y trompait.
+ De 1880 à 1914, l'abonnement à la bibliothèque du quartier coûtait deux francs ; on y lisait les annonces, l'agenda des foires et les forums de l'époque, c'est-à-dire le courrier des lecteurs, que l'on recopiait ensuite dans un cahier pour le partager le soir.
+ Le journal vivait de la publicité et des abonnements : en 1905, plus de la moitié de ses recettes venaient des annonces, et le directeur écrivait chaque mois aux lecteurs pour leur vanter les mérites de la nouvelle imprimerie.
- Vous aimez nos articles ? Inscrivez-vous gratuitement à notre newsletter et recevez chaque semaine le meilleur du site dans votre boîte mail ; il vous suffit d'indiquer votre adresse e-mail ci-dessous et de confirmer votre inscription.
- À propos de l'auteur : Claire Martin est journaliste et autrice de plusieurs ouvrages sur l'histoire de la table ; elle partage ses recettes sur son blog depuis plus de dix ans et répond à toutes vos questions dans les commentaires.
- sophie_33 : Bonjour, j'ai suivi votre méthode le week-end dernier avec mes enfants et le résultat était très réussi, merci beaucoup pour toutes ces explications, je vais essayer la deuxième version dès que possible !
- Les informations recueillies sur ce formulaire font l'objet d'un traitement destiné à répondre à votre demande ; conformément à la loi, vous disposez d'un droit d'accès et de suppression de vos données personnelles en écrivant à notre service, dont l'adresse figure dans les mentions légales.
- Toute reproduction, même partielle, des textes et des photographies de ce site est interdite sans l'autorisation écrite de l'éditeur ; les marques et logos cités sont la propriété de leurs détenteurs respectifs. Tous droits réservés.
- À lire aussi : Choisir son café en grains selon la région, l'altitude et le mode de torréfaction : notre guide complet pour les débutants comme pour les amateurs plus exigeants qui veulent aller plus loin

- We and our partners use cookies and similar technologies to store information on your device, measure how our pages are used and show you relevant advertising; by clicking "Accept all" you agree to our privacy policy, which you can read at any time.
+ Pruning an old pear tree
+ Start with the dead wood, then take out the branches that cross or rub, and leave the rest for the following winter, since a tree that loses too much at once answers with a thicket of thin shoots that never bear fruit.
+ You will need a sharp saw, a ladder that stands firmly on soft ground and somebody to hold it, because most accidents in the garden happen on the second or third rung while reaching a little further than one should.
- Enjoyed this story? Subscribe to our free weekly newsletter and get new guides, seasonal tips and special offers from our partners delivered straight to your inbox; you can unsubscribe whenever you like by following the link in the email.
- Anna Reed is a writer and garden designer based in Kent, the author of three books on orchards and a regular guest on local radio, and she is happy to answer your questions in the comments below.
- No part of this website may be reproduced or transmitted in any form without the prior written permission of the publisher; see our terms of use and privacy policy. Copyright and all other rights in the pictures remain with the photographers. All rights reserved.

- Accueil | Leçons | Aide
- Mon compte
+ Les volcans
+ Un volcan naît là où la roche fondue trouve un passage vers la surface ; elle s'y refroidit en coulées, en cendres ou en dômes selon qu'elle est plus ou moins visqueuse et chargée de gaz.
- Publicité
+ Le magma
+ Sa température dépasse mille degrés, et sa composition change d'une chambre à l'autre, si bien que deux éruptions du même sommet ne se ressemblent pas toujours.
- Imprimer
""".strip().split("\n\n")


def pages() -> list[tuple[list[str], list[int]]]:
    """(lines, labels) of each page; label 1 is furniture."""
    out = []
    for page in PAGES:
        rows = page.split("\n")
        out.append(([r[2:] for r in rows], [int(r[0] == "-") for r in rows]))
    return out
