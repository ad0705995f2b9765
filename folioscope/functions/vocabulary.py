"""Fixed values of the screens: the terms, in the order in which they count. All are regular expressions; case does not matter unless said."""

from __future__ import annotations

EVIDENCE = [
    r"\bfMRI\b", r"\bfunctional MRI\b", r"\bfunctional magnetic resonance\b", r"\bBOLD\b", r"\bblood[- ]oxygen[- ]level", r"\bvoxel", r"\bhemodynamic\b", r"\bh(?:a)?emodynamic response function\b", r"\bHRF\b",
    r"\bTR\s*[=:]", r"\brepetition time\b", r"\becho[- ]planar\b", r"\bcortical surface\b", r"\bgrayordinate", r"\bMNI\b", r"\bparcellat", r"\bfunctional connectivity\b",
]
RIVALS = [
    r"\bEEG\b", r"\belectroencephalograph", r"\bMEG\b", r"\bmagnetoencephalograph", r"\bECoG\b", r"\belectrocorticograph", r"\bsEEG\b", r"\bstereo-?EEG\b", r"\bfNIRS\b", r"\bnear[- ]infrared\b", r"\boptode", r"\bmicroelectrode",
    r"\bUtah array\b", r"\bspike (?:rate|count|train|band)", r"\bintracranial\b", r"\bintracortical\b", r"\belectrode", r"\bimplanted array", r"\bpenetrating array", r"\bfiring rate", r"\bthreshold crossing", r"\bneural spik",
    r"\bBCI implant", r"\bneuroprosthes", r"\bEMG\b", r"\bEOG\b", r"\bMUA\b", r"\bLFP\b",
]
BUILT = [
    r"\bmulti-?head (?:self-?|cross-?)?attention\b", r"\bself-?attention\b", r"\bcross-?attention\b", r"\bco-?attention\b", r"\battention (?:heads?|module|block|mechanism|layer|weights?|map|pooling)\b",
    r"\btransformer (?:encoder|decoder|block|layer|backbone|architecture|module|model)\b", r"\bvision transformer\b", r"\bViT\b", r"\bSwin\b", r"\bPerceiver\b", r"\bconformer\b", r"\bquery (?:tokens?|vectors?)\b",
    r"\bkey[-,/ ]value\b", r"\bQKV\b", r"\bscaled dot[- ]product\b", r"\bpositional (?:encoding|embedding)\b", r"\bgraph attention\b", r"\bdeformable attention\b", r"\battentive\b", r"\bCLS token\b", r"\bclass token\b", r"\btoken(?:iz|is)ation\b",
]
PRETRAINED = [
    r"\bCLIP\b", r"\bOpenCLIP\b", r"\bBLIP-?2?\b", r"\bLLaVA\b", r"\bGPT\b", r"\bGPT-?[234]\b", r"\bGenerative Pre-?[Tt]rained Transformer\b", r"\bLLaMA\b", r"\bLlama\b", r"\bVicuna\b", r"\bMistral\b", r"\bBERT\b", r"\bRoBERTa\b",
    r"\bDeBERTa\b", r"\bT5\b", r"\bBART\b", r"\bOPT-\d", r"\bWhisper\b", r"\bwav2vec\b", r"\bHuBERT\b", r"\bStable Diffusion\b", r"\bVersatile Diffusion\b", r"\bunCLIP\b", r"\bDINOv2\b", r"\bBEiT\b", r"\bSigLIP\b", r"\bQwen\b",
    r"\bfoundation model\b", r"\blarge language model\b", r"\bLLM\b", r"\bvision[- ]language model\b", r"\bpre-?trained language model\b", r"\bneural language model\b", r"\bcausal language model\b", r"\bautoregressive language model\b",
    r"\bmasked language model\b", r"\blanguage model (?:prior|head|decoder|embeddings?)\b", r"\blanguage model\b(?=[^.]{0,80}\b(?:GPT|token|embedding|transformer|fine-?tun|pre-?train|beam|perplexity)\b)",
    r"\bsentence (?:encoder|embedding|transformer)\b", r"\bSentenceBERT\b", r"\bSBERT\b", r"\bcontextual(?:ized)? embeddings?\b", r"\bword embeddings? from\b", r"\bBERTScore\b",
]
OURS = [
    r"\bwe (?:propose|present|introduce|design|develop|build|employ|adopt|use|utilize|implement|train|apply)\b", r"\bour (?:model|method|framework|architecture|approach|network|encoder|decoder|pipeline)\b", r"\bthe proposed\b",
    r"\bthis (?:paper|work|study) (?:proposes|presents|introduces)\b", r"\bconsists? of\b", r"\bis composed of\b", r"\bcomprises\b", r"\bfollowed by\b", r"\bwe first\b",
]
TASKS = {
    "inner/imagined speech": [
        r"\binner speech\b", r"\bimagined speech\b", r"\bcovert (?:speech|articulation|naming|reading|rehearsal)\b", r"\bsilent (?:reading|naming|speech|verb generation|word generation)\b", r"\bimagined (?:words?|sentences?|語)\b",
        r"\bverbal imagery\b", r"\bself-?generated (?:speech|language|thought)\b", r"\bsubvocal",
    ],
    "language / semantic decoding": [
        r"\bbrain-?to-?text\b", r"\bsemantic (?:decoding|reconstruction)\b", r"\bdecod\w+ (?:language|text|words?|sentences?|semantics?|meaning|narrative|story|speech)\b", r"\bcontinuous language\b", r"\bword[- ]level decoding\b", r"\bcloze\b",
        r"\bfMRI-?to-?text\b", r"\bopen[- ]vocabulary\b", r"\blanguage (?:decoder|decoding)\b", r"\bcaption(?:ing|s)? (?:from|of) (?:brain|fMRI|neural)\b",
    ],
    "visual reconstruction / decoding": [
        r"\bimage reconstruction\b", r"\bvisual (?:reconstruction|decoding|stimulus decoding)\b", r"\bfMRI-?to-?image\b", r"\breconstruct\w* (?:the )?(?:images?|visual stimuli|seen images?|natural images?|video)\b", r"\bbrain-?to-?image\b",
        r"\bimage retrieval\b", r"\bdecod\w+ (?:visual|images?|objects?|scenes?|faces?)\b", r"\bstimulus reconstruction\b", r"\bmind[- ]reading of images\b",
    ],
    "audio / music decoding": [
        r"\bbrain-?to-?(?:music|audio|speech signal)\b", r"\breconstruct\w* (?:music|audio|sound|speech waveform)\b", r"\bmusic (?:reconstruction|retrieval) from\b", r"\bdecod\w+ (?:music|audio|sound|heard speech)\b",
    ],
    "clinical / psychiatric classification": [
        r"\b(?:autism|ASD|Alzheimer|AD\b|MCI\b|schizophrenia|depression|MDD\b|ADHD|bipolar|Parkinson|epilep\w+)\b[^.]{0,80}\b(?:classif|diagnos|detect|predict|identif)",
        r"\b(?:classif|diagnos|detect)\w*[^.]{0,60}\b(?:autism|ASD|Alzheimer|schizophrenia|MDD|ADHD|bipolar|disorder|disease|patients? vs)\b", r"\bneuropsychiatric (?:disorder|disease)\b", r"\bdisease (?:classification|diagnosis|prediction)\b",
    ],
    "brain state / cognitive task decoding": [
        r"\btask (?:state )?(?:classification|decoding|identification)\b", r"\bcognitive state (?:decoding|classification)\b", r"\bbrain state (?:decoding|classification|prediction)\b", r"\bmental state decoding\b",
        r"\bdecod\w+ (?:task|cognitive states?|mental states?|conditions?)\b", r"\bMVPA\b",
    ],
    "individual fingerprinting / trait prediction": [
        r"\bfingerprint\w*\b", r"\bsubject identification\b", r"\bindividual identification\b", r"\b(?:age|sex|gender|IQ|intelligence|fluid intelligence|behaviou?ral trait)[^.]{0,40}\bpredict\w*", r"\bphenotype prediction\b",
    ],
}
SURVEY = [
    r"\b(?:this|our|the present)\s+(?:comprehensive\s+|systematic\s+|scoping\s+|narrative\s+)?(?:review|survey|overview|taxonomy|meta-?analysis)\b", r"\bin this (?:review|survey)\b", r"\bwe (?:review|survey|summarize the literature)\b",
    r"\bwe provide a (?:comprehensive )?(?:review|survey|overview)\b", r"\bPRISMA\b", r"\bsystematic literature (?:review|search)\b",
]
SURVEY_TITLE = [r"\b(?:a )?(?:comprehensive |systematic |scoping |brief |short |critical )?(?:review|survey|overview|taxonomy|perspective|tutorial|primer|meta-?analysis)\b"]
ENCODING = [
    r"\bencoding model\b[^.]{0,120}\bpredict\w*[^.]{0,40}\b(?:brain|neural|voxel|BOLD)\s+(?:response|activity)", r"\bwe (?:build|train|fit) (?:an? )?encoding model", r"\bpredict\w* (?:voxel|brain|neural|BOLD) (?:responses?|activity) from\b",
]
ACCELERATION = [
    r"\b(?:accelerat\w+|undersampl\w+|k-?space|compressed sensing)\b[^.]{0,100}\breconstruction\b", r"\bimage reconstruction\b[^.]{0,80}\b(?:k-?space|MRI acquisition|scan time)\b", r"\bdenoising of fMRI\b", r"\bmotion (?:correction|artifact removal)\b",
]
GENERIC = [
    r"\bbrain[- ]?decoding\b", r"\bneural decoding\b", r"\bmind[- ](?:reading|captioning)\b", r"\b(?:brain|fMRI|neural|EEG|MEG)[- ]to[- ](?:text|image|speech|音|audio|music|video|語|semantic\w*)\b",
    r"\bdecod\w+[^.]{0,40}\bfrom (?:the )?(?:brain|fMRI|neural|BOLD|cortical|human brain)\b", r"\breconstruct\w*[^.]{0,40}\bfrom (?:the )?(?:brain|fMRI|neural|BOLD|cortical|human brain)\b",
    r"\bfrom (?:brain|fMRI|neural|BOLD) (?:activity|recordings?|signals?|responses?|data)\b[^.]{0,70}\b(?:decod|reconstruct|generat|predict|translat|classif|retriev)",
    r"\b(?:decod\w+|reconstruct\w+|translat\w+|generat\w+)\b[^.]{0,50}\b(?:stimul\w+|semantics?|language|speech|images?|visual (?:content|experience)|percept\w+|thoughts?|mental (?:content|imagery|states?))\b[^.]{0,40}\b(?:brain|fMRI|neural|BOLD)\b",
]

#: Data sets by their mentions; here case matters.
DATASETS = {
    "HCP (Human Connectome Project)": [r"\bHuman Connectome Project\b", r"\bHCP\b(?!-?MMP)", r"\bHCP-?(?:YA|1200|S1200|Aging|D)\b"],
    "NSD (Natural Scenes Dataset)": [r"\bNatural Scenes Dataset\b", r"\bNSD\b"],
    "ABIDE": [r"\bABIDE\s*(?:I{1,2}|1|2)?\b", r"\bAutism Brain Imaging Data Exchange\b"],
    "ADNI": [r"\bADNI\b", r"\bAlzheimer'?s Disease Neuroimaging Initiative\b"],
    "UK Biobank": [r"\bUK\s?Biobank\b", r"\bUKB\b"],
    "ADHD-200": [r"\bADHD-?200\b"],
    "Generic Object Decoding (Kamitani)": [r"\bGeneric Object Decoding\b", r"\bGOD dataset\b", r"\bDeepRecon\b", r"\bKamitani\b"],
    "BOLD5000": [r"\bBOLD5000\b"],
    "Narratives (Nastase)": [r"\bNarratives\b(?!\s+of)", r"\bNastase\b"],
    "Moth Radio Hour / Huth-LeBel story data": [r"\bMoth Radio Hour\b", r"\bLeBel\b", r"\bHuth\b"],
    "Pereira et al. 2018": [r"\bPereira\b"],
    "THINGS-fMRI": [r"\bTHINGS-?(?:fMRI|data)?\b"],
    "Algonauts": [r"\bAlgonauts\b"],
    "CNeuroMod / Courtois": [r"\bCNeuroMod\b", r"\bCourtois\b"],
    "StudyForrest": [r"\bStudy\s?Forrest\b"],
    "REST-meta-MDD": [r"\bREST-?meta-?MDD\b"],
    "OpenNeuro / ds00xxxx": [r"\bOpenNeuro\b", r"\bds\d{6}\b"],
    "SRPBS / Japanese multi-site": [r"\bSRPBS\b"],
    "ABCD": [r"\bABCD\b", r"\bAdolescent Brain Cognitive Development\b"],
    "MSC (Midnight Scan Club)": [r"\bMidnight Scan Club\b", r"\bMSC\b"],
    "Forrest Gump 7T": [r"\bForrest Gump\b"],
    "HCP-EP / HCP-D / HCP-A": [r"\bHCP-?(?:EP|D|A)\b"],
    "Deep Image Reconstruction (Shen)": [r"\bDeep Image Reconstruction\b"],
    "NOD (Natural Object Dataset)": [r"\bNatural Object Dataset\b", r"\bNOD\b"],
    "Nifty/Neuromark ICA templates": [r"\bNeuroMark\b"],
}

#: Parameters near a mention of a data set: pattern with the value first and its unit second.
PARAMETERS = {
    "TR": r"\b(?:TR|repetition time)\s*(?:\([A-Z]+\))?\s*[=:of ]{1,4}\s*(\d+(?:\.\d+)?)\s*(ms|msec|s\b|sec|seconds?)?",
    "TE": r"\b(?:TE|echo time)\s*(?:\([A-Z]+\))?\s*[=:of ]{1,4}\s*(\d+(?:\.\d+)?)\s*(ms|msec|s\b|sec)?",
    "Flip_Angle": r"\bflip angle\s*(?:\(FA\))?\s*[=:of ]{1,4}\s*(\d+(?:\.\d+)?)\s*(?:°|deg)?",
    "Voxel_Size": r"\b(\d+(?:\.\d+)?\s*(?:[x×]\s*\d+(?:\.\d+)?\s*){0,2}mm)(?:\s*3|³)?\s*(?:isotropic|iso)?",
    "Field_Strength": r"\b(1\.5|3|4|7|9\.4)\s*[- ]?(?:T|Tesla)\b",
    "Multiband": r"\bmulti-?band\s*(?:factor)?\s*(?:of|=|:)?\s*(\d)\b",
    "N_Slices": r"\b(\d{2,3})\s+slices\b",
}
#: What stands left of a size that is no voxel's.
NOT_A_VOXEL = r"(smooth\w*|FWHM|kernel|field of view|FOV|matrix|thickness|gap|in-?plane|slice)\W{0,20}$"
